"""Token-id output with fixed-width bit packing.

A shard is one byte string::

    magic "BITIDS01" | width, block_ids (u32) | n_ids, n_docs, n_blocks (u64)
    | block offsets (u64 each, into the payload) | document starts (u64, n_docs + 1)
    | document ids (i64) | payload

Every id takes ``width`` bits, the least that hold the vocabulary; a block of ``block_ids`` ids (a
multiple of 8) begins on a byte, so block b decodes alone and ids [i, j) need only their blocks.
Shards are rows of a Parquet table (``part, seq, inside, n_ids, n_docs, shard``): Spark's
committer makes the files whole or absent on any shared store. ``inside`` is the number of ids
before the shard in its part; the ids before each part come from sums over the parts. Documents stand in ascending doc_id order, none
crosses a shard.

Null text is an empty text (its end id only). Rows with a null doc_id come first. Rows that repeat
a doc_id are documents of their own, ordered by text. An empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path, shuffle_width, table, text_or_empty, vocabulary_path
from .encoding import encoder
from .memory import task
from .ranges import Ranges

MAGIC = b"BITIDS01"
_HEAD = struct.Struct("<8sIIQQQ")


def width_for(vocabulary: int) -> int:
    """Least bits that hold ids 0 .. vocabulary - 1."""
    return max(1, (int(vocabulary) - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Little-endian bit string, ``width`` bits an id, padded to 8 ids with zeros."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} needs more than {width} bits")
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), width), np.uint8)
    for lane in range(8):
        at, shift = divmod(lane * width, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[:, at + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack_bits(data: bytes | np.ndarray, width: int, n: int) -> np.ndarray:
    """The first n ids, as uint32."""
    rows = -(-n // 8)
    raw = np.frombuffer(data, np.uint8, rows * width).reshape(rows, width)
    out = np.empty((rows, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(8):
        at, shift = divmod(lane * width, 8)
        value = np.zeros(rows, np.uint64)
        for k in range((shift + width + 7) // 8):
            value |= raw[:, at + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


def build_shard(ids: np.ndarray, starts: np.ndarray, doc_ids: np.ndarray, width: int, block_ids: int = 4096) -> bytes:
    if block_ids % 8:
        raise ValueError("block_ids must be a multiple of 8")
    n_blocks = -(-len(ids) // block_ids)
    offsets = np.arange(n_blocks, dtype="<u8") * (block_ids * width // 8)
    head = _HEAD.pack(MAGIC, width, block_ids, len(ids), len(doc_ids), n_blocks)
    return b"".join((head, offsets.tobytes(), starts.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(), pack_bits(ids, width)))


class Shard:
    """Random access into one shard."""

    def __init__(self, data: bytes):
        magic, self.width, self.block_ids, self.n_ids, n_docs, n_blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size
        self.offsets = np.frombuffer(data, "<u8", n_blocks, at)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at := at + 8 * n_blocks).astype(np.int64)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at := at + 8 * (n_docs + 1))
        self.payload = memoryview(data)[at + 8 * n_docs :]

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """ids [lo, hi), reading only the blocks that hold them."""
        hi = self.n_ids if hi is None else min(hi, self.n_ids)
        if hi <= lo:
            return np.empty(0, np.uint32)
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        n = min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids
        got = unpack_bits(self.payload[int(self.offsets[first]) :], self.width, n)
        return got[lo - first * self.block_ids : hi - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


_NULL_ID = -(1 << 63)
_ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("part", T.IntegerType())])
_SHARDS = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("seq", T.IntegerType()), ("inside", T.LongType()), ("n_ids", T.LongType()), ("n_docs", T.LongType()), ("shard", T.BinaryType()))])
_DIGEST = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def _moved_as(width: int) -> str:
    return "<u2" if width <= 16 else "<u4"


def encode_documents(documents: DataFrame, tokenizer: str, end_id: int, width: int, ranges: Ranges) -> DataFrame:
    """doc_id, ids (16 bits each if that is enough, else 32), n, tie, part: each text encoded where it was read, so that ids and not texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.uint32(end_id).tobytes()
        kind = _moved_as(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                packed, n = [], []
                for ids in enc.encode_many(part.column("text").to_pylist()):
                    got = np.frombuffer(ids + end, "<u4")
                    packed.append(got.astype(kind).tobytes())
                    n.append(len(got))
                place = ranges.place(part.column("doc_id").to_numpy(), part.column("tie").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary()), pa.array(n, pa.int64()), part.column("tie"), pa.array(place)], names=_ENCODED.names)

    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), text_or_empty().alias("text"))
    return rows.withColumn("tie", F.xxhash64("text")).mapInArrow(task("encoding")(run), _ENCODED)


def write_shards(documents: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, shard_ids: int = 1 << 20, block_ids: int = 4096) -> None:
    """Encode ``documents`` and write shards of about ``shard_ids`` ids in ascending doc_id order."""
    spark, width = documents.sparkSession, width_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, inside, held, docs, counts = TaskContext.get().partitionId(), 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq, inside, held, docs, counts
            starts = np.concatenate(([0], np.cumsum(counts)))
            shard = build_shard(np.frombuffer(b"".join(held), _moved_as(width)), starts, np.array(docs, np.int64), width, block_ids)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([inside], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([shard], pa.binary())], names=_SHARDS.names)
            seq, inside, held, docs, counts = seq + 1, inside + int(starts[-1]), [], [], []
            return row

        size = 0
        for batch in batches:
            for d, ids, n in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True):
                held.append(ids)
                docs.append(d)
                counts.append(n)
                size += n
                if size >= shard_ids:
                    yield flush()
                    size = 0
        if docs:
            yield flush()

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("key")
    ranges = Ranges.of(documents.select(key), shuffle_width(spark))
    placed = encode_documents(documents, tokenizer, end_id, width, ranges).repartitionById(ranges.parts, F.col("part"))
    placed.sortWithinPartitions("doc_id", "tie").mapInArrow(task("encoding")(run), _SHARDS).write.parquet(path)


def part_bases(spark: SparkSession, path: str) -> DataFrame:
    """part, before: ids before each part. One row for each partition that wrote, so it may be broadcast."""
    from pyspark.sql import Window

    parts = spark.read.schema(_SHARDS).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("total"))
    return parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))


def shards(spark: SparkSession, path: str) -> DataFrame:
    """base (ids before the shard in the whole output), n_ids, shard."""
    rows = spark.read.schema(_SHARDS).parquet(path).join(F.broadcast(part_bases(spark, path)), "part")
    return rows.select((F.col("before") + F.col("inside")).alias("base"), "n_ids", "shard")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("shard"), strict=True):
                shard = Shard(data.as_py())
                raw = memoryview(shard.ids().astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * int(a) : 4 * int(b)]) for a, b in zip(shard.starts[:-1], shard.starts[1:], strict=True)]
                null = shard.doc_ids == _NULL_ID
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64(), mask=null), pa.array(base + shard.starts[:-1]), pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64())], names=_DIGEST.names)

    return shards(spark, path).select("base", "shard").mapInArrow(task("encoding")(run), _DIGEST)


def read_ids(spark: SparkSession, path: str, lo: int, hi: int) -> np.ndarray:
    """ids [lo, hi) of the whole output: the counts say which shards overlap, and only those are asked for."""
    own = spark.read.schema(_SHARDS).parquet(path)
    places = own.select("part", "seq", "inside", "n_ids").join(F.broadcast(part_bases(spark, path)), "part")
    base = (F.col("before") + F.col("inside")).alias("base")
    wanted = places.select("part", "seq", base, "n_ids").filter((F.col("base") < hi) & (F.col("base") + F.col("n_ids") > lo)).orderBy("base").collect()
    parts = []
    for r in wanted:
        for found in own.filter((F.col("part") == r["part"]) & (F.col("seq") == r["seq"])).select("shard").toLocalIterator():
            parts.append(Shard(found["shard"]).ids(max(0, lo - r["base"]), hi - r["base"]))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


#: Ids of word_bpe_49k.json, special tokens included.
WORD_BPE_IDS = 49_408
END_ID = 2


def op9_bitpacked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bitids")
    write_shards(table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"), WORD_BPE_IDS, END_ID)
    return read_documents(spark, path)
