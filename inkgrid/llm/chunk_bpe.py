"""BPE encoding and decoding by content-defined chunks that documents share.

Cutting. A hash rolls over the last 32 bytes of a text; where its leading eight bits become zero the text is cut (at the
next code point), so equal passages are cut alike wherever they stand. Runs that never cut are cut every 2,048 bytes.

Reuse. The chunks of all documents are counted by 128-bit digests (a shuffle of digests, not of texts). Of those that
occur more than once, the ``shared`` ones that save most are encoded once for the whole corpus and sent to all tasks:
at most 16,384 chunks of at most 2,051 bytes, 34 MB whatever the corpus. Every other chunk is looked up in the
memory of its worker, by its bytes, and encoded once there. Whether a chunk is found changes costs, never ids.

Repair. Ids of a chunk are those of its text up to a cut that lies before a blank behind a visible character: there no
token, pre-token or normalisation reaches across (the vocabulary is asked once whether blanks leave ids). What is open,
the end of one chunk and the beginning of the next, is encoded anew as one string, grown by further chunks
until it ends at such places on both sides or at the ends of the text: the ids on both sides agree exactly with those of
the whole text from there on.

Defined results: a null text is empty and has no ids; repeated rows and null ids give a row each; an empty table gives
no row; texts of any length are cut, a run without blanks is one open string. Further columns are dropped unless named
in ``keep``; ``ids`` and ``decoded`` cannot be kept.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import memory
from .common import table, vocabulary_path
from .encoding import encoder
from .memory import task
from .textkit import utf8_chunks

#: Bytes in the rolling window (a power of two), bits that must be zero at a cut, longest chunk.
WINDOW, BITS, LONGEST = 32, 8, 2048
#: Chunks encoded for the whole corpus at once. With LONGEST this bounds what is collected and broadcast.
SHARED = 16_384
#: Bytes of chunks, and of open strings, that a worker remembers before it begins anew.
KEPT = 24 << 20

_GEAR = np.random.Generator(np.random.PCG64(271828)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 10]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def chunk_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of all cuts in the joined bytes of texts, bounds of texts included, ascending."""
    n = len(buf)
    if not n:
        return np.zeros(1, np.int64)
    rolled, step = _GEAR[buf], 1
    while step < WINDOW:
        wider = rolled.copy()
        wider[step:] += rolled[:-step] << np.uint32(step)
        rolled, step = wider, 2 * step
    hit = (rolled >> np.uint32(32 - BITS)) == 0
    hit[1:] &= ~hit[:-1]  # a run of one character cuts once at most
    cuts = np.flatnonzero(hit) + 1
    begin = offsets[np.searchsorted(offsets, cuts - 1, side="right") - 1]
    cuts = cuts[cuts - begin >= WINDOW]  # a window lies in one text
    starts = (buf & 0xC0) != 0x80
    cuts = np.unique(np.concatenate((_to_character(cuts, starts), offsets)))
    wide = np.diff(cuts)
    more = np.maximum(-(-wide // LONGEST) - 1, 0)
    if more.any():
        first = np.cumsum(more) - more
        inside = np.repeat(cuts[:-1], more) + LONGEST * (np.arange(more.sum()) - np.repeat(first, more) + 1)
        cuts = np.unique(np.concatenate((cuts, _to_character(inside, starts))))
    return cuts


def _to_character(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The next beginning of a code point from each place on."""
    out = places.copy()
    for _ in range(3):
        inner = out < len(starts)
        inner[inner] = ~starts[out[inner]]
        out[inner] += 1
    return out


class Solver:
    """Chunks and open strings to ids, with what the worker remembers of them."""

    def __init__(self, path: str, shared: dict[bytes, tuple] | None = None):
        self.encoder, self.shared = encoder(path), shared or {}
        self.chunks: dict[bytes, tuple] = {}
        self.opened: dict[bytes, bytes] = {b"": b""}
        self.chunk_bytes = self.open_bytes = 0

    def settled(self, buf: np.ndarray) -> np.ndarray:
        """Places where a text may be parted without changing its ids."""
        blank, before = _BLANK[buf[1:]], _VISIBLE[buf[:-1]]
        if self.encoder.folds:  # blanks leave no ids: what stands before them does not matter
            before = before | (buf[:-1] >= 0x80)
        return np.flatnonzero(blank & before) + 1

    def solve(self, chunks: list[bytes], first: list[int], last: list[int]) -> dict[bytes, tuple]:
        """chunk -> (open beginning, ids, open end); ids are None in a chunk that cannot be parted."""
        cores = [c[a : max(a, b)].decode() for c, a, b in zip(chunks, first, last, strict=True)]
        ids = self.encoder.encode_many(cores)
        return {c: (c[:a], i, c[b:]) if b >= 0 else (c, None, b"") for c, a, b, i in zip(chunks, first, last, ids, strict=True)}

    def entries(self, data: bytes, buf: np.ndarray, cuts: np.ndarray) -> list[tuple]:
        pieces = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        own, shared = self.chunks, self.shared
        found = [shared.get(p) or own.get(p) for p in pieces]
        lacking = {p: i for i, p in enumerate(pieces) if found[i] is None}
        if lacking:
            at = np.fromiter(lacking.values(), np.int64, len(lacking))
            new = self.solve(list(lacking), *_parts(self.settled(buf), cuts[at], cuts[at + 1]))
            if self.chunk_bytes > KEPT:
                own.clear()
                self.chunk_bytes = 0
            own.update(new)
            self.chunk_bytes += sum(2 * len(p) + 200 for p in new)
            found = [e if e is not None else new[p] for e, p in zip(found, pieces, strict=True)]
        return found

    def encode(self, data: bytes, buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit bytes."""
        cuts = chunk_cuts(buf, offsets)
        entries = self.entries(data, buf, cuts)
        bounds = np.searchsorted(cuts, offsets).tolist()
        texts: list[list[bytes]] = []
        joins: list[list[bytes]] = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            ids, opened, pending = [], [], b""
            for begin, core, end in entries[lo:hi]:
                pending += begin
                if core is not None:
                    opened.append(pending)
                    ids.append(core)
                    pending = end
            texts.append(ids)
            joins.append([*opened, pending])
        self._open({s for part in joins for s in part})
        known = self.opened
        return [b"".join([x for s, core in zip(opened, [*ids, b""], strict=True) for x in (known[s], core)]) for opened, ids in zip(joins, texts, strict=True)]

    def _open(self, wanted: set[bytes]) -> None:
        lacking = [s for s in wanted if s not in self.opened]
        if self.open_bytes > KEPT:
            self.opened, self.open_bytes = {b"": b""}, 0
            lacking = [s for s in wanted if s]
        self.opened.update(zip(lacking, self.encoder.encode_many([s.decode() for s in lacking]), strict=True))
        self.open_bytes += sum(2 * len(s) + 150 for s in lacking)


def _parts(settled: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last settled place inside each chunk [lo, hi), from its beginning; 0 and -1 where there is none."""
    if not len(settled):
        return [0] * len(lo), [-1] * len(lo)
    a, b = np.searchsorted(settled, lo + 1), np.searchsorted(settled, hi) - 1
    some = a <= b
    return np.where(some, settled[np.minimum(a, len(settled) - 1)] - lo, 0).tolist(), np.where(some, settled[np.maximum(b, 0)] - lo, -1).tolist()


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Counter]:
    for batch in batches:
        for _, _, buf, offsets in utf8_chunks(batch.column("text")):
            data, cuts = buf.tobytes(), chunk_cuts(buf, offsets).tolist()
            yield Counter([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def chunk_counts(docs: DataFrame) -> DataFrame:
    """digest, n, bytes of every distinct chunk of the corpus. Tasks add up what they can hold before the shuffle."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bytes", T.LongType())])

    @task("chunk_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counted: dict[bytes, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array([v[0] for v in counted.values()], pa.int64()), pa.array([v[1] for v in counted.values()], pa.int64())], names=schema.names)

        counted: dict[bytes, list[int]] = {}
        for found in _cut_batches(batches):
            for chunk, n in found.items():
                entry = counted.setdefault(_digest(chunk), [0, len(chunk)])
                entry[0] += n
            if len(counted) > 1 << 17:
                yield rows(counted)
                counted = {}
        yield rows(counted)

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return parts.groupBy("digest").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes"))


def shared_chunks(docs: DataFrame, path: str, most: int = SHARED) -> dict[bytes, tuple]:
    """The chunks whose reuse saves most bytes, each encoded once for the whole corpus."""
    spark = docs.sparkSession
    ranked = chunk_counts(docs).filter("n > 1").orderBy(F.expr("(n - 1) * bytes").desc(), "digest").limit(most)
    wanted = spark.sparkContext.broadcast({bytes(r[0]) for r in ranked.select("digest").collect()})
    if not wanted.value:
        return {}

    @task("chunk_bpe")
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for found in _cut_batches(batches):
            new = {d: c for c in found if (d := _digest(c)) in wanted.value and d not in sent}
            sent |= new.keys()
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], names=["digest", "chunk"])

    @task("chunk_bpe")
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver(path)
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            data = b"".join(chunks)
            buf, cuts = np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum([len(c) for c in chunks])))
            found = solver.solve(chunks, *_parts(solver.settled(buf), cuts[:-1], cuts[1:])) if chunks else {}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *[pa.array([v[i] for v in found.values()], pa.binary()) for i in range(3)]], names=["chunk", "head", "ids", "tail"])

    once = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(pick, "digest binary, chunk binary").dropDuplicates(["digest"])
    rows = once.select("chunk").mapInArrow(encode, "chunk binary, head binary, ids binary, tail binary").collect()
    return {bytes(r["chunk"]): (bytes(r["head"]), None if r["ids"] is None else bytes(r["ids"]), bytes(r["tail"])) for r in rows}


class Decoder:
    """ids to text as the library's ``decode(ids, skip_special_tokens=False)``."""

    def __init__(self, path: str):
        self.tokenizer = encoder(path).tokenizer
        self.pieces = None
        if self.tokenizer.decoder is None:  # then the library joins tokens by blanks
            size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
            self.pieces = [self.tokenizer.id_to_token(i) for i in range(size)]

    def decode(self, ids: bytes) -> str:
        own = np.frombuffer(ids, "<u4").tolist()
        if self.pieces is None:
            return self.tokenizer.decode(own, skip_special_tokens=False)
        return " ".join([self.pieces[i] for i in own])


#: The solver of the run that this worker took part in last.
_solvers: dict[str, Solver] = {}
memory.remembers("chunk_bpe", _solvers.clear)


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None, decode: bool = False, most: int = SHARED) -> DataFrame:
    """doc_id, [keep,] ids (little-endian unsigned 32-bit) and, with ``decode``, the text decoded from them."""
    keep = list(keep or [])
    if taken := {c.lower() for c in keep} & {"doc_id", "ids", "decoded"}:
        raise ValueError(f"columns of the result cannot be kept beside it: {sorted(taken)}")
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep if c.lower() != "text"])
    carried = [f for f in plain.schema.fields if f.name != "text" or "text" in keep]
    names = [f.name for f in carried]
    shared, own = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, most)), uuid.uuid4().hex
    schema = T.StructType([*carried, T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.StringType())] * decode])

    @task("chunk_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own not in _solvers:
            _solvers.clear()
            _solvers[own] = Solver(path, shared.value)
        solver, decoder = _solvers[own], Decoder(path) if decode else None
        for batch in batches:
            for lo, hi, buf, offsets in utf8_chunks(batch.column("text")):
                ids = solver.encode(buf.tobytes(), buf, offsets)
                columns = [*[batch.column(c).slice(lo, hi - lo) for c in names], pa.array(ids, pa.binary())]
                if decoder:
                    columns.append(pa.array([decoder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return plain.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded of rows that hold ``ids``; null ids are none."""

    @task("chunk_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decoder.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("decoded", T.StringType())]))


def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), decode=True)
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
