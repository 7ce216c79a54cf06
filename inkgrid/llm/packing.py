"""Vector bin packing of training examples into fixed-length sequences.

Each piece is a vector (tokens, 1 segment, loss-bearing tokens) and each sequence a bin with a limit
on each. A bin is filled by the dot-product heuristic: of the pieces that fit, take the one whose
vector, in units of the limits, has the largest dot product with what the bin has left; ties go to
the earlier piece. When none fits and cutting is allowed, the piece with the largest dot product is
cut to what is left. The last bins of a partition are cut into lengths that are powers of two,
which need no padding.

Packing runs where the rows are: nothing is shuffled, no group is gathered, and a partition holds
at most ``pool`` open pieces. Null text is an empty text (its end id only); repeated rows are packed
each for itself; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_or_empty, vocabulary_path
from .encoding import encoder
from .memory import task


@dataclass
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


@dataclass
class Piece:
    owner: int
    start: int
    length: int
    #: loss-bearing flags of the piece, or None if every token bears loss
    loss: np.ndarray | None = None

    @property
    def loss_tokens(self) -> int:
        return self.length if self.loss is None else int(self.loss.sum())


@dataclass
class Packer:
    """Fills one sequence after another; ``out`` gets (piece, sequence, offset)."""

    limits: Limits
    cut: bool = True
    pool_size: int = 256
    pool: list[Piece] = field(default_factory=list)
    vectors: list[tuple[float, float, float]] = field(default_factory=list)
    sequence: int = 0
    out: list[tuple[Piece, int, int]] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        """Whole sequences of a long piece are placed at once, what remains waits in the pool."""
        limits = self.limits
        while piece.length > limits.tokens or piece.loss_tokens > limits.loss:
            if not self.cut:
                raise ValueError(f"a piece of {piece.length} tokens passes the limits")
            head = self._fitting(piece, limits.tokens, limits.loss)
            first, piece = self._split(piece, head)
            self._place([first])
        if piece.length == limits.tokens:
            self._place([piece])
        elif piece.length:
            self.pool.append(piece)
            self.vectors.append((piece.length / limits.tokens, 1 / limits.segments, piece.loss_tokens / limits.loss))
            if len(self.pool) >= self.pool_size:
                self._drain(self.pool_size // 2, last=False)

    def finish(self) -> None:
        self._drain(0, last=True)

    def _fitting(self, piece: Piece, tokens: int, loss: int) -> int:
        """Longest head within both limits."""
        if piece.loss is None:
            return min(piece.length, tokens, loss)
        return min(piece.length, tokens, int(np.searchsorted(np.cumsum(piece.loss), loss, side="right")))

    def _split(self, piece: Piece, head: int) -> tuple[Piece, Piece]:
        a = Piece(piece.owner, piece.start, head, None if piece.loss is None else piece.loss[:head])
        return a, Piece(piece.owner, piece.start + head, piece.length - head, None if piece.loss is None else piece.loss[head:])

    def _place(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.out.append((p, self.sequence, at))
            at += p.length
        self.sequence += 1

    def _place_in_powers(self, pieces: list[Piece]) -> None:
        """Cut a short bin at powers of two, the largest first."""
        rest, left = sum(p.length for p in pieces), list(pieces)
        while left:
            room, taken = 1 << (rest.bit_length() - 1), []
            rest -= room
            while room:
                p = left.pop(0)
                if p.length > room:
                    p, tail = self._split(p, room)
                    left.insert(0, tail)
                taken.append(p)
                room -= p.length
            self._place(taken)

    def _drain(self, keep: int, last: bool) -> None:
        limits = self.limits
        pool = self.pool
        v = np.array(self.vectors).reshape(-1, 3)
        # whole numbers decide what fits
        size = np.array([(p.length, 1, p.loss_tokens) for p in pool], np.int64).reshape(-1, 3)
        alive = np.ones(len(pool), bool)
        n = len(pool)
        while n > keep:
            left = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
            taken: list[Piece] = []
            while n and left.min() > 0:
                weight = v @ (left / (limits.tokens, limits.segments, limits.loss))
                fits = alive & (size <= left).all(axis=1)
                if fits.any():
                    k = int(np.where(fits, weight, -1.0).argmax())
                    taken.append(pool[k])
                    left = left - size[k]
                    alive[k] = False
                    n -= 1
                    continue
                k = int(np.where(alive, weight, -1.0).argmax())
                head = self._fitting(pool[k], int(left[0]), int(left[2])) if self.cut else 0
                if not head:
                    break
                first, pool[k] = self._split(pool[k], head)
                taken.append(first)
                left = left - (head, 1, first.loss_tokens)
                size[k] = (pool[k].length, 1, pool[k].loss_tokens)
                v[k] = size[k] / (limits.tokens, limits.segments, limits.loss)
            if self.cut and left[0] > 0:
                self._place_in_powers(taken)
            else:
                self._place(taken)
        stay = np.flatnonzero(alive)
        self.pool = [pool[i] for i in stay]
        self.vectors = [tuple(v[i]) for i in stay]


_PIECES = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("loss_tokens", T.LongType()))])


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits(), pool_size: int = 256, loss_from: str | None = None) -> DataFrame:
    """One row a piece. ``loss_from`` names a column with the number of leading characters that bear no
    loss (a prompt); without it every token bears loss. sequence_id is unique over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.uint32(end_id).tobytes()
        first = TaskContext.get().partitionId() << 32
        packer = Packer(limits, pool_size=pool_size)
        held: dict[int, tuple[int | None, bytes, list[int]]] = {}
        owner = 0

        def flush() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in _PIECES.names]
            for p, seq, at in packer.out:
                doc, ids, left = held[p.owner]
                left[0] -= p.length
                if not left[0]:
                    del held[p.owner]
                row = (doc, p.start, p.length, zlib.crc32(memoryview(ids)[4 * p.start : 4 * (p.start + p.length)]), len(ids) // 4, first + seq, at, p.loss_tokens)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            packer.out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_PIECES.names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column("text").to_pylist()
                skips = part.column("skip").to_pylist()
                heads = enc.encode_many([t[:s] for t, s in zip(texts, skips, strict=True)]) if any(skips) else [b""] * len(texts)
                bodies = enc.encode_many([t[s:] for t, s in zip(texts, skips, strict=True)] if any(skips) else texts)
                for doc, a, b in zip(part.column("doc_id").to_pylist(), heads, bodies, strict=True):
                    ids = a + b + end
                    n = len(ids) // 4
                    loss = (np.arange(n) >= len(a) // 4) if a else None
                    held[owner] = (doc, ids, [n])
                    packer.add(Piece(owner, 0, n, loss))
                    owner += 1
                if packer.out:
                    yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    skip = F.greatest(F.coalesce(F.col(loss_from).cast("int"), F.lit(0)), F.lit(0)) if loss_from else F.lit(0)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), skip.alias("skip")).mapInArrow(task("encoding")(run), _PIECES)


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


_EXAMPLES = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("loss_tokens", T.LongType()), ("ends", T.BooleanType()), ("ids_crc32", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))])


def pack_examples(turns: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits(), pool_size: int = 256, answers: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a piece of a conversation (conv_id, turn, role, text): its turns one after another, each with an end id, of which the
    tokens of ``answers`` bear loss. An answer stays with what it answers: a conversation is one piece, placed whole, unless
    it passes a limit by itself; then it is cut where the limit is reached, and ``ends`` marks its last piece.

    Turns are ordered by (turn, role, text), nulls first; a null role or text is empty; rows without conv_id are one conversation of their
    own (conv_id null). Turns stream through the task of their conversation, of which at most one sequence is held. Sequences are not filled up by
    cutting, so they end in padding. sequence_id is unique over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        first = TaskContext.get().partitionId() << 32
        packer = Packer(limits, cut=False, pool_size=pool_size)
        held: dict[int, tuple[int | None, bool, bytes]] = {}
        ids, loss, start, conv, begun, owner = np.empty(0, np.uint32), np.empty(0, bool), 0, None, False, 0

        def add(n: int, last: bool) -> None:
            nonlocal ids, loss, start, owner
            held[owner] = (conv, last, ids[:n].tobytes())
            packer.add(Piece(owner, start, n, loss[:n]))
            ids, loss, start, owner = ids[n:], loss[n:], start + n, owner + 1

        def flush() -> pa.RecordBatch:
            rows = [(*held.pop(p.owner), p, seq, at) for p, seq, at in packer.out]
            packer.out.clear()
            columns = zip(*[(c, p.start, p.length, p.loss_tokens, last, zlib.crc32(data), first + seq, at) for c, last, data, p, seq, at in rows], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.bool_() if n == "ends" else pa.int64()) for n, x in zip(_EXAMPLES.names, columns, strict=True)], names=_EXAMPLES.names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                coded = enc.encode_many(part.column("text").to_pylist())
                for c, role, data in zip(part.column("conv_id").to_pylist(), part.column("role").to_pylist(), coded, strict=True):
                    if begun and c != conv:
                        add(len(ids), True)
                        ids, loss, start = np.empty(0, np.uint32), np.empty(0, bool), 0
                    conv, begun = c, True
                    own = np.concatenate((np.frombuffer(data, np.uint32), end))
                    ids, loss = np.concatenate((ids, own)), np.concatenate((loss, np.full(len(own), role in answers)))
                    while len(ids) > limits.tokens or loss.sum() > limits.loss:
                        add(packer._fitting(Piece(0, 0, len(ids), loss), limits.tokens, limits.loss), False)
                if packer.out:
                    yield flush()
        if begun:
            add(len(ids), True)
        packer.finish()
        if packer.out:
            yield flush()

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(task("encoding")(run), _EXAMPLES)


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` packed whole for instruction training: answers bear loss, and a sequence holds at most 1024 tokens, 16
    conversations and 768 tokens that bear loss."""
    return pack_examples(table(spark, sf_dir, "conversations"), vocabulary_path("byte_bpe_50k.json"), limits=Limits(tokens=1024, segments=16, loss=768))
