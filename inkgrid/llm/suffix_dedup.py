"""Suffix-array dedup: maximal repeated byte strings across the corpus, found on enhanced suffix arrays.

Every position whose next ``least`` bytes lie in one document is a suffix of the corpus. Equal strings
of ``least`` bytes have the same anchor in them (the k-gram of least hash, rightmost on ties), so the
runs of suffixes that share an anchor are dealt out by its content and equal suffixes meet in one
bucket. In a bucket the suffixes are sorted by all their bytes, adjacent common prefixes give the
enhanced suffix array, and a stack scan of those gives the interval tree: an interval is a repeated
string with all its occurrences, and it is maximal within the surroundings of its anchor if these
differ in the byte before (left diversity; their next bytes differ as it is an interval). Two
operators read the trees:

* ``remove_repeats`` cuts, from every maximal interval, all occurrences but the earliest.
* ``repeat_groups`` joins intervals across the surroundings of anchors into maximal repeats of any
  length, each with all its occurrences.

Scale: an anchor (about 3 in 100 positions) travels as 32 bytes, without text. Runs that equal each
other whole, byte before the first, are one kind: equal suffixes to the end of their surroundings, so
one leaf of the tree. Kinds are folded within the task, then by bucket, and the first one of each
brings its bytes once, if its anchor has other kinds. Kinds are equal if two 64-bit hashes (of the
anchor and of the whole run) are; everything else compares bytes. A bucket of over ``crowd`` kinds is
split by the content of each window: the same scan runs on windows one by one, with the same result.
No task holds a document group and nothing is collected.

Contract: bytes of null text are none. A document is never matched with itself at the same place.
Rows with null doc_id come first in the order. If a doc_id repeats, its rows are ordered by md5 of the
text, and equal rows are one document, which all of them stand for: they get equal results, and
none is removed for the sake of another. Texts below ``least`` bytes are kept whole; a text of any
length is handled whole, in one task. An empty table gives an empty table. A carried column with the
name of an outcome gives way to it; all others come back as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, text_or_empty
from .memory import task
from .textkit import byte_prefix, gram_hash, mix, rightmost_minima, span_hash, utf8_chunks

LEAST, GRAM, CROWD = 100, 32, 4096


# ---------------------------------------------------------------- enhanced suffix array


def sort_suffixes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, group: np.ndarray | None = None) -> np.ndarray:
    """Order of the suffixes [start, end) by group, then by their first ``depth`` bytes, a prefix before what it begins."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate((buf, np.zeros(depth, np.uint8))), depth)
    rows = np.empty((len(starts), depth + 10), np.uint8)
    rows[:, :8] = 0 if group is None else group.astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8:-2] = view[starts]
    room = np.minimum(ends - starts, depth)
    if len(room) and room.min() < depth:
        rows[:, 8:-2][np.arange(depth)[None, :] >= room[:, None]] = 0
    rows[:, -2:] = room.astype(">u2").view(np.uint8).reshape(-1, 2)
    return np.argsort(rows.view(f"S{depth + 10}").ravel(), kind="stable")


def common_prefixes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, depth: int, group: np.ndarray | None = None) -> np.ndarray:
    """lcp[i] of sorted suffixes i-1 and i, at most ``depth``, 0 at the first one of a group; no prefix passes an end."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    padded = np.concatenate((buf, np.zeros(depth, np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 16):
        hi = min(len(order), lo + (1 << 16))
        differs = view[starts[order[lo:hi]]] != view[starts[order[lo - 1 : hi - 1]]]
        first = differs.argmax(axis=1)
        out[lo:hi] = np.where(differs.any(axis=1), first, depth)
    room = (ends - starts)[order]
    out[1:] = np.minimum(out[1:], np.minimum(room[1:], room[:-1]))
    if group is not None:
        out[1:][group[order][1:] != group[order][:-1]] = 0
    return out


def interval_tree(lcp: np.ndarray, least: int) -> np.ndarray:
    """Stack scan: rows (value, first, last, parent) of every interval with common prefix >= ``least``;
    parent is a row or -1."""
    found: list[list[int]] = []
    stack: list[list[int]] = []  # [value, first, children]
    values = lcp.tolist() + [0]
    for i in range(1, len(values)):
        first, children = i - 1, []
        value = values[i] if values[i] >= least else 0
        while stack and value < stack[-1][0]:
            top = stack.pop()
            found.append([top[0], top[1], i - 1, -1])
            row = len(found) - 1
            for c in top[2]:
                found[c][3] = row
            first = top[1]
            if stack and value <= stack[-1][0]:
                stack[-1][2].append(row)
            else:
                children = [row] if value else []
        if value and (not stack or value > stack[-1][0]):
            stack.append([value, first, children])
    return np.array(found, np.int64).reshape(-1, 4)


def left_diverse(before: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Flag of each interval whose occurrences are not all preceded by the same byte. ``before`` is in
    suffix order, below 0 where nothing precedes or several bytes do (which differs from everything)."""
    change = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))))
    return change[tree[:, 2]] > change[tree[:, 1]]


def deepest(tree: np.ndarray, n: int) -> np.ndarray:
    """Row of the deepest interval around each of n sorted suffixes, or -1."""
    leaf = np.full(n, -1)
    for row in np.argsort(tree[:, 0], kind="stable").tolist():
        leaf[tree[row, 1] : tree[row, 2] + 1] = row
    return leaf


def maximal_repeats(texts: list[bytes], least: int = LEAST, depth: int | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, all occurrences (text, position)) of every maximal repeated string of ``least`` to
    ``depth`` bytes (default: the longest text) in a small set of texts."""
    depth = depth or max(map(len, texts), default=0)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    starts = np.arange(len(buf))
    fits = bounds[owner + 1] - starts >= least if len(buf) else np.empty(0, bool)
    starts, owner = starts[fits], owner[fits]
    if len(starts) < 2:
        return []
    order = sort_suffixes(buf, starts, bounds[owner + 1], depth)
    lcp = common_prefixes(buf, starts, bounds[owner + 1], order, depth)
    tree = interval_tree(lcp, least)
    at = starts[order]
    before = np.where(at == bounds[owner[order]], -1, buf[at - 1].astype(np.int64))
    out = []
    for (value, first, last, _), keep in zip(tree.tolist(), left_diverse(before, tree), strict=True):
        if keep:
            own = order[first : last + 1]
            out.append((value, sorted(zip(owner[own].tolist(), (starts[own] - bounds[owner[own]]).tolist(), strict=True))))
    return out


# ---------------------------------------------------------------- distributed form

_ANCHORS = T.StructType([T.StructField("key", T.LongType()), T.StructField("ctx", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("span", T.IntegerType())])
#: ``span``: windows less one (8 bits), code of the byte before the run (9 bits), of the byte after it (9 bits), then
#: whether the row is a further occurrence of a kind of its task, and whether it stands for several. A code is the
#: byte + 1, or 0: nothing there, or several bytes.
_BEFORE, _AFTER, _SETTLED, _SEVERAL = 8, 17, 1 << 26, 1 << 27
_WINDOWS, _CODES = 0xFF, (0x1FF << _BEFORE) | (0x1FF << _AFTER)


def _code(span: np.ndarray, shift: int) -> np.ndarray:
    return (span >> shift) & 0x1FF


def _folded(span: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The spans at ``starts`` with the codes and flags of their whole segments."""
    out = span[starts] & ~_CODES
    for shift in (_BEFORE, _AFTER):
        code = _code(span, shift)
        low = np.minimum.reduceat(code, starts)
        out |= np.where(low == np.maximum.reduceat(code, starts), low, 0) << shift
    several = np.diff(np.concatenate((starts, [len(span)]))) > 1
    return out | np.where(several | (np.bitwise_or.reduceat(span, starts) & _SEVERAL > 0), _SEVERAL, 0)


def _windows(offsets: np.ndarray, least: int) -> np.ndarray:
    """Starts of all strings of ``least`` bytes within one text each."""
    n = np.maximum(np.diff(offsets) - least + 1, 0)
    return np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def anchors(texts: DataFrame, least: int, gram: int, fold: bool = True, held: int = 1 << 20) -> DataFrame:
    """A row for each run of windows with one anchor: key (hash of the anchor), ctx (hash of all their bytes). With
    ``fold`` the first row of a kind in a run of ``held`` rows stands for the others, whose keys are scattered."""
    width = least - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, ctx, doc, lo, span = (np.concatenate(c) for c in zip(*parts, strict=True))
            parts.clear()
            if fold:
                order = np.lexsort((lo, doc, key, ctx))
                k, c = key[order], ctx[order]
                new = np.concatenate(([True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])))
                span[order[new]] = _folded(span[order], np.flatnonzero(new))
                settled = order[~new]
                span[settled] |= _SETTLED
                key[settled] = mix(doc[settled].view(np.uint64) + lo[settled].astype(np.uint64)).view(np.int64)  # nothing is compared with these
            for at in range(0, len(key), 1 << 17):
                cut = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (key, ctx, doc, lo.astype(np.int32), span.astype(np.int32))], names=_ANCHORS.names)

        size = 0
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for first, _, buf, offsets in utf8_chunks(batch.column("text")):
                p = _windows(offsets, least)
                if not len(p):
                    continue
                prefix = byte_prefix(buf)
                grams = gram_hash(prefix, gram)
                chosen = rightmost_minima(grams, width)[p]
                begin = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
                end = np.concatenate((begin[1:], [len(p)])) - 1
                lo, hi, at = p[begin], p[end], chosen[begin]
                row = np.searchsorted(offsets, lo, side="right") - 1
                before = np.where(lo > offsets[row], buf[lo - 1].astype(np.int64) + 1, 0)
                close = hi + least
                after = np.where(close < offsets[row + 1], buf[np.minimum(close, len(buf) - 1)].astype(np.int64) + 1, 0)
                parts.append([grams[at].view(np.int64), span_hash(prefix, lo, close).view(np.int64), ids[first + row].astype(np.int64), lo - offsets[row], (hi - lo) | (before << _BEFORE) | (after << _AFTER)])
                size += len(lo)
                if size >= held:
                    yield from flush()
                    size = 0
        if parts:
            yield from flush()

    return texts.select("doc", "text").mapInArrow(task("suffixes")(run), _ANCHORS)


MARK, SHARED, SOLO = 0, 1, 2
_KINDS = T.StructType([T.StructField("sort", T.ByteType()), *_ANCHORS.fields])


def kinds(rows: DataFrame, solo: bool) -> DataFrame:
    """Streams anchors sorted by key, ctx, doc, lo. ``sort`` MARK: a further occurrence of a kind; SHARED: the first of its
    kind, folded, whose anchor has other kinds; SOLO (if asked for): of a kind with several occurrences and no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] | None = None  # the last first row, folded so far
        known = False  # whether its anchor had a kind before it

        def out(sort: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
            mark = sort == MARK
            cols = [*cols[:3], cols[3].astype(np.int32), cols[4].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(sort), *(pa.array(c, mask=mark) for c in cols[:2]), *map(pa.array, cols[2:])], names=_KINDS.names)

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in _ANCHORS.names]
            settled = (cols[4] & _SETTLED) > 0
            if settled.any():
                yield out(np.full(int(settled.sum()), MARK, np.int8), [c[settled] for c in cols])
                cols = [c[~settled] for c in cols]
            if not len(cols[0]):
                continue
            own = 0 if pending is None else 1
            if pending is not None:
                cols = [np.concatenate((a, b)) for a, b in zip(pending, cols, strict=True)]
            key, ctx = cols[:2]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])))
            again = ~new
            again[:own] = False
            if again.any():
                yield out(np.full(int(again.sum()), MARK, np.int8), [c[again] for c in cols])
            starts = np.flatnonzero(new)
            first = [c[starts] for c in cols[:4]] + [_folded(cols[4], starts)]
            k = first[0]
            same = k[1:] == k[:-1]
            shared = np.concatenate(([known], same))
            last = bool(shared[-1])
            shared[:-1] |= same
            done = [c[:-1] for c in first]
            sort = np.where(shared[:-1], SHARED, np.where(solo & ((done[4] & _SEVERAL) > 0), SOLO, MARK)).astype(np.int8)
            if (sort > MARK).any():
                yield out(sort[sort > MARK], [c[sort > MARK] for c in done])
            pending, known = [c[-1:] for c in first], last
        if pending is not None:
            sort = SHARED if known else SOLO if solo and pending[4][0] & _SEVERAL else MARK
            if sort > MARK:
                yield out(np.array([sort], np.int8), pending)

    placed = rows.repartition("key").sortWithinPartitions("key", "ctx", "doc", "lo")
    return placed.mapInArrow(task("suffixes")(run), _KINDS)


_CONTEXTS = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("bytes", T.BinaryType()), T.StructField("span", T.IntegerType()), T.StructField("off", T.IntegerType())])
_KIND = [T.StructField("kkey", T.LongType()), T.StructField("kctx", T.LongType())]


def contexts(texts: DataFrame, least: int, named: bool) -> DataFrame:
    """From doc, text, places (key, ctx, lo, span, crowded): the bytes of each kind, by anchor; of a crowded anchor the bytes
    of each window, by themselves (``off`` of its kind). With ``named`` also the kind."""
    schema = T.StructType(_CONTEXTS.fields + (_KIND if named else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("places"), strict=True):
                data = text.encode()
                fields = places.values
                key, ctx, lo, span, crowded = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("key", "ctx", "lo", "span", "crowded"))
                plain = np.flatnonzero(~crowded)
                size = (span & _WINDOWS) + least
                cols = [key[plain], lo[plain], [data[a : a + n] for a, n in zip(lo[plain].tolist(), size[plain].tolist(), strict=True)], span[plain], np.zeros(len(plain), np.int32), plain]
                if len(plain) < len(key):
                    raw = np.frombuffer(data, np.uint8)
                    dense = np.flatnonzero(crowded)
                    n = (span[dense] & _WINDOWS) + 1
                    kind = np.repeat(dense, n)
                    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    p = lo[kind] + off
                    before = np.where(off > 0, raw[p - 1].astype(np.int64) + 1, _code(span[kind], _BEFORE))
                    inner = off < np.repeat(n, n) - 1
                    after = np.where(inner, raw[np.minimum(p + least, len(raw) - 1)].astype(np.int64) + 1, _code(span[kind], _AFTER))
                    single = (before << _BEFORE) | (after << _AFTER) | (span[kind] & _SEVERAL)
                    whole = span_hash(byte_prefix(raw), p, p + least).view(np.int64)
                    more = [whole, p, [data[a : a + least] for a in p.tolist()], single, off, kind]
                    cols = [a + b if isinstance(a, list) else np.concatenate((a, b)) for a, b in zip(cols, more, strict=True)]
                at = cols[5]
                kinds_ = [pa.array(key[at]), pa.array(ctx[at])] if named else []
                for a in range(0, len(at), 1 << 15):
                    cut = slice(a, a + (1 << 15))
                    own = [pa.array(cols[0][cut]), pa.array(np.full(len(at[cut]), doc, np.int64)), pa.array(cols[1][cut].astype(np.int32)), pa.array(cols[2][cut], pa.binary()), pa.array(cols[3][cut].astype(np.int32)), pa.array(np.asarray(cols[4][cut], np.int32))]
                    yield pa.RecordBatch.from_arrays(own + [x.slice(a, 1 << 15) for x in kinds_], names=schema.names)

    return texts.mapInArrow(task("suffixes")(run), schema)


class _Bucket:
    """The suffixes of some anchors' kinds: enhanced suffix array and interval tree, down to the ends of the kinds."""

    def __init__(self, keys: list[int], docs: list[int], los: list[int], data: list[bytes], spans: list[int], least: int):
        self.least, self.spans = least, np.array(spans)
        sizes = np.array([len(d) for d in data])
        self.buf = np.frombuffer(b"".join(data), np.uint8)
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        n = sizes - least + 1
        self.row = np.repeat(np.arange(len(data)), n)
        self.inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.starts, self.ends = base[self.row] + self.inner, (base + sizes)[self.row]
        self.doc, self.lo = np.array(docs, np.int64)[self.row], np.array(los, np.int64)[self.row] + self.inner
        anchor = np.cumsum(np.concatenate(([0], np.array(keys)[1:] != np.array(keys)[:-1])))[self.row]
        depth = int(sizes.max())
        self.order = sort_suffixes(self.buf, self.starts, self.ends, depth, anchor)
        self.tree = interval_tree(common_prefixes(self.buf, self.starts, self.ends, self.order, depth, anchor), least)

    def removed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc, lo, hi of the occurrences of maximal repeats but the earliest of each; of those that start at one place the longest."""
        tree, order, n = self.tree, self.order, len(self.order)
        # what precedes the first window of a run is another anchor's affair: it counts as different
        before = np.where(self.inner > 0, self.buf[self.starts - 1].astype(np.int64), -1)[order]
        maximal = left_diverse(before, tree)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((self.lo, self.doc))] = np.arange(n)
        rank = rank[order]
        ends = np.stack((tree[:, 1], tree[:, 2] + 1), axis=1).ravel()
        least = np.minimum.reduceat(np.append(rank, n), ends)[::2]
        cur = deepest(tree, n)
        while True:
            up = (cur >= 0) & ((least[cur] == rank) | ~maximal[cur])
            if not up.any():
                break
            cur[up] = tree[cur[up], 3]
        cut = order[cur >= 0]
        return self.doc[cut], self.lo[cut], self.lo[cut] + tree[cur[cur >= 0], 0]

    def pieces(self) -> dict[str, np.ndarray]:
        """A row for each kind of each piece: the windows with one set of occurrences that follow each other in the kinds.
        row, inner (of its start in the kind), windows, gdoc, gpos (its first occurrence), before, after (codes)."""
        n, tree = len(self.order), self.tree
        cls = -1 - self.row  # a window of one kind only: the kind is its class
        size = np.ones(n, np.int64)
        roots = tree[tree[:, 3] < 0]
        for value, first, last, _ in roots.tolist():
            own = self.order[first : last + 1]
            cls[own], size[own] = first, last - first + 1
        single = cls < 0
        before = np.where(self.inner > 0, self.buf[self.starts - 1].astype(np.int64) + 1, _code(self.spans[self.row], _BEFORE))
        past = self.starts + self.least
        after = np.where(past < self.ends, self.buf[np.minimum(past, len(self.buf) - 1)].astype(np.int64) + 1, _code(self.spans[self.row], _AFTER))
        # a class starts a piece unless the class before it has the same occurrences, one to the left
        starts = self.inner == 0
        starts[1:] |= size[1:] != size[:-1]
        starts[1:] |= single[1:] != single[:-1]
        names, group = np.unique(cls, return_inverse=True)
        known = np.flatnonzero(self.inner > 0)
        low, high = np.full(len(names), n + len(names)), np.full(len(names), -n - len(names) - 2)
        np.minimum.at(low, group[known], cls[known - 1])
        np.maximum.at(high, group[known], cls[known - 1])
        starts |= (low != high)[group] & ~single
        some = np.zeros(len(names), bool)
        np.logical_or.at(some, group[starts & ~single], True)
        starts |= some[group] & ~single
        at = np.flatnonzero(starts)
        windows = np.diff(np.append(at, n))
        last = at + windows - 1
        alive = ~single[at] | ((self.spans[self.row[at]] & _SEVERAL) > 0)
        at, windows, last = at[alive], windows[alive], last[alive]
        if not len(at):
            return {}
        # members of a piece side by side, the earliest first
        kin = np.lexsort((self.lo[at], self.doc[at], np.where(single[at], -1 - at, cls[at])))
        at, windows, last = at[kin], windows[kin], last[kin]
        tag = np.where(single[at], -1 - at, cls[at])
        head = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1])))
        per = np.diff(np.append(head, len(at)))

        def common(code: np.ndarray) -> np.ndarray:
            lo = np.minimum.reduceat(code, head)
            return np.repeat(np.where(lo == np.maximum.reduceat(code, head), lo, 0), per)

        first = np.repeat(at[head], per)
        return {"row": self.row[at], "inner": self.inner[at], "windows": windows, "gdoc": self.doc[first], "gpos": self.lo[first], "before": common(before[at]), "after": common(after[last])}


_CUTS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])
_PIECES = T.StructType([*_KIND, *(T.StructField(c, T.IntegerType()) for c in ("off", "windows")), T.StructField("gdoc", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("gpos", "before", "after"))])


def scan_buckets(rows: DataFrame, least: int, named: bool, held: int = 1 << 16) -> DataFrame:
    """Contexts, dealt by key: what is to be cut (doc, lo, hi), or with ``named`` the pieces of each kind."""

    def outcome(cols: dict[str, list]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(cols["key"], cols["doc"], cols["lo"], cols["bytes"], cols["span"], least)
        if not named:
            if len(bucket.tree):
                doc, lo, hi = bucket.removed()
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=_CUTS.names)
            return
        if found := bucket.pieces():
            row = found["row"]
            off = np.array(cols["off"])[row] + found["inner"]
            kind = [np.array(cols[c], np.int64)[row] for c in ("kkey", "kctx")]
            small = [pa.array(x.astype(np.int32)) for x in (found["gpos"], found["before"], found["after"])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, kind), pa.array(off.astype(np.int32)), pa.array(found["windows"].astype(np.int32)), pa.array(found["gdoc"]), *small], names=_PIECES.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {}
        windows = 0
        for batch in batches:
            key = batch.column("key").to_numpy()
            size = pc.binary_length(batch.column("bytes")).to_numpy() - least + 1
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if windows >= held and key[a] != cols["key"][-1]:
                    yield from outcome(cols)
                    cols, windows = {}, 0
                for name, column in zip(batch.schema.names, batch.columns, strict=True):
                    cols.setdefault(name, []).extend(column.slice(a, b - a).to_pylist())
                windows += int(size[a:b].sum())
        if cols:
            yield from outcome(cols)

    placed = rows.repartition("key").sortWithinPartitions("key", "doc", "lo")
    return placed.mapInArrow(task("suffixes")(run), _PIECES if named else _CUTS)


_KEPT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])


def cut_out(texts: DataFrame, with_text: bool) -> DataFrame:
    """``row`` and the outcome, from ``text`` and ``marks`` (array of lo, hi in bytes). ``kept`` is the remaining text, if
    asked for; of a character cut in two, the rest is dropped."""
    schema = T.StructType([texts.schema["row"], *_KEPT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks"), strict=True):
                data = text.encode()
                if not marks.is_valid or not len(marks):
                    rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), text if with_text else None))
                    continue
                lo, hi = (marks.values.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
                edge = np.bincount(lo, minlength=len(data) + 1) - np.bincount(hi, minlength=len(data) + 1)
                gone = np.cumsum(edge)[:-1] > 0
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], names=schema.names)

    return texts.select("row", "text", "marks").mapInArrow(task("suffixes")(run), schema)


def _ordered(documents: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(row with the carried columns, doc, text of every row; doc, text of every document). doc orders the documents: doc_id
    itself if that is unique, otherwise the place among the distinct (doc_id, text), which a distributed sort numbers."""
    boxed = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    rows = documents.select(boxed.alias("row"), F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text"))
    if not rows.groupBy("doc").count().filter("count > 1 OR doc IS NULL").limit(1).count():
        return rows, rows.select("doc", "text")
    tied = rows.withColumnRenamed("doc", "id").withColumn("tie", F.md5("text"))
    places = tied.select("id", "tie").distinct().orderBy(F.col("id").asc_nulls_first(), "tie")
    numbered = materialize(places.select(F.col("id").alias("pid"), F.col("tie").alias("ptie"), F.monotonically_increasing_id().alias("doc")), "places")
    joined = tied.join(numbered, F.col("id").eqNullSafe(F.col("pid")) & (F.col("tie") == F.col("ptie")))
    rows = materialize(joined.select("row", "doc", "text"), "ordered")
    return rows, rows.select("doc", "text").dropDuplicates(["doc"])


def _scanned(found: DataFrame, texts: DataFrame, least: int, crowd: int, named: bool) -> DataFrame:
    """The outcome of the buckets of all SHARED kinds."""
    shared = found.filter(F.col("sort") == SHARED)
    crowded = shared.groupBy("key").count().filter(F.col("count") > crowd).select("key", F.lit(True).alias("crowded"))
    place = F.struct("key", "ctx" if named else F.lit(0).cast("long").alias("ctx"), "lo", "span", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    gathered = shared.join(crowded, "key", "left").select("doc", place.alias("place")).groupBy("doc").agg(F.collect_list("place").alias("places"))
    return scan_buckets(contexts(texts.join(gathered, "doc"), least, named), least, named)


def _checked(least: int, gram: int) -> None:
    if not 8 <= gram <= least <= 255 + gram:
        raise ValueError("gram must be 8 bytes or more, and least - gram at most 255")


def remove_repeats(documents: DataFrame, carry: list[str], least: int = LEAST, gram: int = GRAM, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """``carry`` columns of every row, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept text."""
    _checked(least, gram)
    rows, texts = _ordered(documents, carry)
    found = materialize(kinds(anchors(texts, least, gram), solo=False), "kinds")
    # the whole run is a repeat of its kind: each further occurrence goes
    again = found.filter(F.col("sort") == MARK).select("doc", "lo", (F.col("lo") + F.col("span").bitwiseAND(_WINDOWS) + least).alias("hi"))
    marks = again.unionByName(_scanned(found, texts, least, crowd, named=False))
    gathered = marks.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    cut = cut_out(rows.join(gathered, "doc", "left"), with_text)
    return cut.select(*[F.col(f"row.`{c}`") for c in carry if c not in _KEPT.names], *_KEPT.names)


# ---------------------------------------------------------------- maximal repeats of any length

_LETTER = T.StructType([T.StructField("gdoc", T.LongType()), T.StructField("gpos", T.IntegerType()), T.StructField("windows", T.IntegerType())])
_LETTERS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("lo", T.ArrayType(T.IntegerType())), T.StructField("letters", T.ArrayType(_LETTER))])


def _stretches(pieces: DataFrame) -> DataFrame:
    """Of each document, the stretches of its repeated windows as letters: pieces that always follow each other are one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("start").to_pydict()
        out: list[tuple] = []
        end, after = None, 0
        for start, windows, gdoc, gpos, before, then in zip(*(t[c] for c in ("start", "windows", "gdoc", "gpos", "before", "after")), strict=True):
            if start != end:
                out.append(([], []))
                after = 0
            lo, letters = out[-1]
            if letters and after and before:
                letters[-1]["windows"] += windows
            else:
                lo.append(start)
                letters.append({"gdoc": gdoc, "gpos": gpos, "windows": windows})
            end, after = start + windows, then
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.struct([("gdoc", pa.int64()), ("gpos", pa.int32()), ("windows", pa.int32())])))], names=_LETTERS.names)

    return pieces.groupBy("doc").applyInArrow(run, _LETTERS)


def _agreed(stretches: DataFrame, backward: bool, width: int = 64) -> DataFrame:
    """gdoc, gpos, more: windows by which all occurrences of a letter agree on the letters that follow (``backward``: precede)
    it. ``width`` letters are compared at a time; letters that agree on all of them go on."""
    spark = stretches.sparkSession
    both = stretches.select(F.reverse("letters").alias("letters")) if backward else stretches.select("letters")
    reach = None
    settled = []
    while True:
        each = both.select("letters", F.posexplode("letters").alias("i", "letter")).select("letters", "i", "letter.gdoc", "letter.gpos")
        if reach is not None:
            each = each.join(reach.select("gdoc", "gpos", "steps", "sofar"), ["gdoc", "gpos"])
        else:
            each = each.withColumn("steps", F.lit(0)).withColumn("sofar", F.lit(0).cast("long"))
        tail = F.slice("letters", F.col("i") + 2 + F.col("steps"), F.lit(width))
        ends = each.select("gdoc", "gpos", "steps", "sofar", tail.alias("tail")).groupBy("gdoc", "gpos", "steps", "sofar").agg(F.min("tail").alias("low"), F.max("tail").alias("high"))
        same = F.zip_with("low", "high", lambda a, b: a.isNotNull() & b.isNotNull() & (a == b))
        differ = F.coalesce(F.array_position(same, False).cast("int"), F.lit(0))
        n = F.when(differ == 0, F.size("low")).otherwise(differ - 1)
        ends = ends.withColumn("n", n)
        sofar = F.col("sofar") + F.aggregate(F.slice("low", F.lit(1), F.col("n")), F.lit(0).cast("long"), lambda s, x: s + x["windows"])
        ends = materialize(ends.select("gdoc", "gpos", (F.col("steps") + F.col("n")).alias("steps"), sofar.alias("sofar"), "n"), "agreed")
        settled.append(ends.filter(F.col("n") < width).select("gdoc", "gpos", F.col("sofar").alias("more")))
        reach = ends.filter(F.col("n") == width)
        if reach.isEmpty():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def repeat_groups(documents: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Maximal repeats of ``least`` bytes and more, of any length, with all their occurrences, a row each: grp_doc, grp_lo (the
    earliest occurrence), length in bytes, doc, lo. A document is named by its doc_id, or by its place in the order if doc_ids
    repeat or are null.

    For every repeated window of ``least`` bytes, the greatest string around it that stands wherever the window stands is a
    group: its occurrences differ in the byte before and in the byte after. A maximal repeat made only of windows that all
    occur elsewhere too is not listed by itself (there can be as many as the square of a text's length); its
    windows are in the groups of those more frequent strings."""
    _checked(least, gram)
    _, texts = _ordered(documents, [])
    found = materialize(kinds(anchors(texts, least, gram), solo=True), "kinds")
    lone = found.filter(F.col("sort") == SOLO).select(
        F.col("key").alias("kkey"), F.col("ctx").alias("kctx"), F.lit(0).alias("off"), (F.col("span").bitwiseAND(_WINDOWS) + 1).alias("windows"), F.col("doc").alias("gdoc"), F.col("lo").alias("gpos"),
        F.shiftright("span", _BEFORE).bitwiseAND(0x1FF).alias("before"), F.shiftright("span", _AFTER).bitwiseAND(0x1FF).alias("after"),
    )
    pieces = _scanned(found, texts, least, crowd, named=True).unionByName(lone)
    every = anchors(texts, least, gram, fold=False).select(F.col("key").alias("kkey"), F.col("ctx").alias("kctx"), "doc", "lo")
    placed = every.join(pieces, ["kkey", "kctx"]).withColumn("start", F.col("lo") + F.col("off"))
    stretches = materialize(_stretches(placed.select("doc", "start", "windows", "gdoc", "gpos", "before", "after")), "stretches")

    letters = stretches.select("doc", F.explode(F.arrays_zip("lo", "letters")).alias("x")).select("doc", "x.lo", "x.letters.*")
    after, before = _agreed(stretches, False).withColumnRenamed("more", "after"), _agreed(stretches, True).withColumnRenamed("more", "before")
    own = letters.groupBy("gdoc", "gpos").agg(F.max("windows").alias("windows"))
    spans = own.join(after, ["gdoc", "gpos"]).join(before, ["gdoc", "gpos"])
    spans = spans.select("gdoc", "gpos", F.col("before").alias("left"), (F.col("before") + F.col("windows") + F.col("after") + least - 1).alias("length"))
    # several letters may lie in one repeat only: the first one names its occurrences
    named = spans.groupBy("gdoc", (F.col("gpos") - F.col("left")).alias("grp_lo"), "length").agg(F.min(F.struct("gpos", "left")).alias("x")).select("gdoc", "grp_lo", "length", "x.gpos", "x.left")
    out = letters.select("doc", "lo", "gdoc", "gpos").join(named, ["gdoc", "gpos"])
    return out.select(F.col("gdoc").alias("grp_doc"), F.col("grp_lo").cast("int").alias("grp_lo"), F.col("length").cast("int").alias("length"), "doc", (F.col("lo") - F.col("left")).cast("int").alias("lo"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(documents, ["doc_id"]).drop("kept")
