"""Whole-text encoding with the tokenizers library, memoised by white-space chunk.

Both public vocabularies split a text into pre-tokens that never reach from a visible character
into a following blank, so the ids of a text are the ids of its chunks ``blanks + visible run`` in
order. Each distinct chunk goes through the library once per worker; texts with white space other
than blank and newline, or with the marks of special tokens, go through it whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from . import memory
from .textkit import byte_prefix, span_hash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Without U+0130: in lower case it ends in a combining dot, which goes with the full stop behind it.
_LETTER = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-ſ"
#: A lone newline; blanks and a word before a full stop or comma; blanks and a visible run; blanks.
_CHUNK = re.compile(rf"(?<![ \n])\n(?=[^ \n])|[ \n]*+[{_LETTER}]++(?=[.,])|[ \n]*+[^ \n]++|[ \n]+")
#: White space that the cuts do not know, special tokens, and the mark used for cutting.
_WHOLE = re.compile("[\x01\t\r\f\v\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]|<\\|")
_WORD = re.compile(rf" ?[{_LETTER}]+")
#: Characters cut at once: a cut takes about a hundred bytes a character.
AT_ONCE = 1 << 18
#: Chunks kept in a ChunkTable before it is emptied.
KEPT = 1_000_000
#: Chunks kept in a ChunkMemory per generation; the generation before the current one is kept too.
MEMORY = 600_000
#: Chunks of the small memory asked first: the earliest ones, which are mostly the common ones.
HOT = 30_000
#: Longest chunk that is kept.
LONGEST = 48


class _Memory(dict):
    """Chunk -> ids; what is asked for in vain is noted in ``lacking``, once, and reads as None."""

    lacking: dict[str, None]

    def __missing__(self, chunk: str) -> None:
        self.lacking[chunk] = None


#: Class of each byte: 1 letter or digit, 2 full stop or comma, 3 blank or newline, 4 other white space or control, 5 part of a character beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[128:] = 5
for _c in range(128):
    if chr(_c).isalnum():
        _CLASS[_c] = 1
    elif chr(_c) in ".,":
        _CLASS[_c] = 2
    elif chr(_c) in " \n":
        _CLASS[_c] = 3
    elif _WHOLE.match(chr(_c)):
        _CLASS[_c] = 4
#: First bytes of the characters beyond ASCII in _WHOLE.
_SUSPECT = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3, 0xEF])


def spans(texts: list[str], data: list[bytes], bare: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(joined bytes, bounds of texts, chunk starts, chunk ends, texts that must go whole). With ``bare``
    chunks leave out the blanks between them."""
    buf = np.frombuffer(b"".join(data), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    none = np.empty(0, np.int64)
    if not len(buf):
        return buf, bounds, none, none, []
    kind = _CLASS[buf]
    some = np.diff(bounds) > 0
    first = np.zeros(len(buf), bool)
    first[bounds[:-1][some]] = True
    before = np.concatenate(([np.uint8(0)], kind[:-1]))
    before[first] = 0

    def owner(at: np.ndarray) -> np.ndarray:
        return np.unique(np.searchsorted(bounds, at, side="right") - 1)

    # white space of other kinds and special tokens: the whole text
    suspects = set(owner(np.flatnonzero((kind == 4) | _SUSPECT[buf])).tolist())
    bar = np.flatnonzero(buf[1:] == 0x7C)
    suspects.update(owner(bar[buf[bar] == 0x3C]).tolist())
    whole = sorted(i for i in suspects if _WHOLE.search(texts[i]))
    # stops after something that is no letter, blanks in a row or at the end: cut by the pattern
    stop = np.flatnonzero((kind == 2) & (before != 1))
    wide = stop[before[stop] == 5]
    lead, tail = buf[wide - 2], buf[wide - 1]
    latin = (lead >= 0xC3) & (lead <= 0xC5) & ~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7))) & ~((lead == 0xC4) & (tail == 0xB0))
    last = bounds[1:][some] - 1
    odd = np.concatenate((np.setdiff1d(stop, wide[latin]), np.flatnonzero((kind == 3) & (before == 3)), last[kind[last] == 3]))
    uneven = sorted(set(owner(odd).tolist()) - set(whole)) if len(odd) else []
    blank = kind == 3
    if bare:
        start = (first | (before == 3) | (kind == 2)) & ~blank
        end = np.concatenate(((blank | (kind == 2))[1:] | first[1:], [True])) & ~blank
    else:
        start = first | blank | (kind == 2)
        start[1:] |= buf[:-1] == 10
        end = np.concatenate((start[1:], [True]))
    for i in (*whole, *uneven):
        start[bounds[i] : bounds[i + 1]] = False
        end[bounds[i] : bounds[i + 1]] = False
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if uneven:
        extra = np.array([x for i in uneven for x in _pattern_spans(texts[i], int(bounds[i]))], np.int64).reshape(-1, 2)
        starts, ends = np.concatenate((starts, extra[:, 0])), np.concatenate((ends, extra[:, 1]))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return buf, bounds, starts, ends, whole


def _pattern_spans(text: str, at: int) -> Iterator[tuple[int, int]]:
    for chunk in _CHUNK.findall(text):
        n = len(chunk.encode())
        yield at, at + n
        at += n


class ChunkTable:
    """Chunk hash -> ids, in flat arrays with open addressing, half full at most: a batch is looked up in a few gathers."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self._resize(21)
        self.hashes, self.start, self.length = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 for none. A hash is never 0."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.slots[slot]
        out = np.where(held == hashes, self.entry[slot], -1)
        rest = np.flatnonzero((held != hashes) & (held != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.slots) - 1)
            held = self.slots[slot[rest]]
            hit = held == hashes[rest]
            out[rest[hit]] = self.entry[slot[rest[hit]]]
            rest = rest[~hit & (held != 0)]
        return out

    def add(self, hashes: np.ndarray, values: list[bytes]) -> None:
        """Distinct hashes that are not in the table, and their ids."""
        flat = np.frombuffer(b"".join(values), np.uint32)
        sizes = np.array([len(v) // 4 for v in values])
        for name, need in (("hashes", self.n + len(sizes)), ("start", self.n + len(sizes)), ("length", self.n + len(sizes)), ("ids", self.used + len(flat))):
            own = getattr(self, name)
            if len(own) < need:
                setattr(self, name, np.concatenate((own, np.zeros(max(need - len(own), len(own)), own.dtype))))
        self.hashes[self.n : self.n + len(sizes)] = hashes
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.length[self.n : self.n + len(sizes)] = sizes
        old, self.n, self.used = self.n, self.n + len(sizes), self.used + len(flat)
        if 2 * self.n > len(self.slots):
            self._resize((2 * self.n).bit_length())
            old = 0
        self._place(old)

    def _resize(self, bits: int) -> None:
        self.bits = bits
        self.slots, self.entry = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _place(self, first: int) -> None:
        """Entries from ``first`` on get their slots."""
        hashes, numbers = self.hashes[first : self.n], np.arange(first, self.n, dtype=np.int32)
        slot, rest = (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(rest):
            free = rest[self.slots[slot[rest]] == 0]
            self.slots[slot[free]] = hashes[free]  # of several for one slot the last stays
            self.entry[slot[free]] = numbers[free]
            rest = rest[self.slots[slot[rest]] != hashes[rest]]
            slot[rest] = (slot[rest] + 1) & (len(self.slots) - 1)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the entries one after another, where each begins, with the end)."""
        sizes = self.length[entries]
        begins = np.concatenate(([0], np.cumsum(sizes)))
        return self.ids[np.repeat(self.start[entries] - begins[:-1], sizes) + np.arange(begins[-1])], begins


class ChunkMemory:
    """Joins the ids of chunks; ``solve`` gives those of chunks not met before, many at once."""

    def __init__(self, solve):
        self.solve = solve
        self.hot: dict[str, bytes] = {}
        self.young = _Memory()
        self.old: dict[str, bytes] = {}

    def join(self, cut: list[list[str]]) -> list[bytes]:
        hot, met = self.hot, self.young
        lacking = met.lacking = {}
        found = [[ids if ids is not None else met[c] for c, ids in zip(chunks, map(hot.get, chunks), strict=True)] for chunks in cut]
        if lacking:
            for c in [c for c in lacking if c in self.old]:
                met[c] = self.old[c]
                del lacking[c]
            new = self.solve(list(lacking))
            met.update(new)
            for chunks, ids in zip(cut, found, strict=True):
                at = -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    ids[at] = met[chunks[at]]
            for c in new:
                if len(c) > LONGEST:
                    del met[c]
                elif len(hot) < HOT:
                    hot[c] = new[c]
        if len(met) > MEMORY:
            self.old, self.young = met, _Memory()
        return [b"".join(ids) for ids in found]


_encoders: dict[str, "TextEncoder"] = {}


class TextEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: White space leaves no ids and case is folded: chunks need neither.
        self.folds = not self._library([" \n "])[0] and self._library(["A"]) == self._library(["a"])
        #: ids that end a word (a suffix says so) or that begin one (a leading blank is part of the id).
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.edge[i] = piece.endswith("</w>") if self.folds else piece.startswith("Ġ")
        self.table = ChunkTable()

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _words(self, words: list[str]) -> list[bytes]:
        """Plain words, many in one text: the library's cost for a text is that of many words. The ids are
        cut at word edges; should their number not be that of the words, each goes alone."""
        out: list[bytes] = []
        for lo in range(0, len(words), 500):
            part = words[lo : lo + 500]
            ids = np.frombuffer(self._library([(" " if self.folds else "").join(part)])[0], "<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(part):
                out += self._library(part)
                continue
            cuts = [0, *(edges + 1).tolist()] if self.folds else [*edges.tolist(), len(ids)]
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _solve(self, chunks: list[str]) -> dict[str, bytes]:
        words = [c for c in chunks if (self.folds or c[:1] == " ") and _WORD.fullmatch(c)]
        new = dict(zip(words, self._words(words), strict=True))
        others = [c for c in chunks if c not in new]
        new.update(zip(others, self._library(others), strict=True))
        return new

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """ids of each text. Chunks not met before go through the library together."""
        if len(texts) > 1 and sum(map(len, texts)) > AT_ONCE:
            half = len(texts) // 2
            return self.encode_many(texts[:half]) + self.encode_many(texts[half:])
        if not texts:
            return []
        lowered = [t.lower() if self.folds and not ("Σ" in t or "İ" in t) else t for t in texts]
        buf, bounds, starts, ends, whole = spans(lowered, [t.encode() for t in lowered], self.folds)
        hashes = span_hash(byte_prefix(buf), starts, ends) | np.uint64(1)
        if self.table.n > KEPT or self.table.used > 16 * KEPT:
            self.table.clear()
        entries = self.table.find(hashes)
        lacking = np.flatnonzero(entries < 0)
        if len(lacking):
            new, at = np.unique(hashes[lacking], return_index=True)
            data = buf.tobytes()
            chunks = [data[a:b].decode() for a, b in zip(starts[lacking[at]].tolist(), ends[lacking[at]].tolist(), strict=True)]
            solved = self._solve(chunks)
            self.table.add(new, [solved[c] for c in chunks])
            entries[lacking] = self.table.find(hashes[lacking])
        ids, begins = self.table.gather(entries)
        cuts = (4 * begins[np.searchsorted(starts, bounds)]).tolist()
        flat = ids.tobytes()
        out = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in whole:
            out[i] = self._library([texts[i]])[0]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


memory.remembers("encoding", _encoders.clear)


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
