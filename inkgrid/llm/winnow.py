"""Document fingerprints by winnowing.

The k-grams of the UTF-8 bytes are hashed with a rolling polynomial; of every window of w hashes the
least is kept, the rightmost on ties, with its position. Any common run of at least w + k - 1 bytes
leaves a common fingerprint (the match guarantee), and no run below k bytes does. A text of fewer
than k bytes is one gram, an empty text has no fingerprint. Fingerprints are strings: base64 of
little-endian (hash, position) pairs of unsigned 32-bit numbers. Likeness is the Jaccard
coefficient of the two hash sets; two empty fingerprints are alike (1.0).

Null text is an empty text. Rows that repeat a doc_id stand next to each other, ordered by text;
a null doc_id comes after all others. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width, table, text_or_empty
from .memory import task
from .ranges import Ranges
from .textkit import byte_prefix, gram_hash, rightmost_minima, span_hash, utf8_chunks

GRAM, WINDOW = 16, 64


def winnow(texts: pa.Array, gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of every text, in order of position."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, buf, offsets in utf8_chunks(texts):
        prefix = byte_prefix(buf)
        grams = gram_hash(prefix, gram)
        best = rightmost_minima(grams, window) if len(grams) >= window else np.empty(0, np.int64)
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n = hi - lo - gram + 1
            if n >= window:
                run = best[lo : lo + n - window + 1]
                at = run[np.concatenate(([True], run[1:] != run[:-1]))]
                hashes = grams[at]
            elif n > 0:
                own = grams[lo : lo + n] >> np.uint64(32)
                at = np.array([lo + n - 1 - int(own[::-1].argmin())])
                hashes = grams[at]
            elif hi > lo:
                at = np.array([lo])
                hashes = span_hash(prefix, at, np.array([hi]))
            else:
                at, hashes = np.empty(0, np.int64), np.empty(0, np.uint64)
            out.append(((hashes >> np.uint64(32)).astype("<u4"), (at - lo).astype("<u4")))
    return out


def to_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    return base64.b64encode(np.column_stack((hashes, positions)).astype("<u4").tobytes()).decode()


def from_string(value: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(base64.b64decode(value), "<u4").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sets of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by as many of the next text's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROWS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])
_LEAST = -(1 << 63)


def in_descending_order(documents: DataFrame) -> DataFrame:
    """doc_id, text, ghost in partitions of descending doc_id; each partition ends with a copy (ghost) of the
    first row after it, and the last one with a copy of the very first row. One shuffle of the texts; the
    driver sees a number a partition. An id that many rows share is split by the texts' hashes."""
    spark = documents.sparkSession
    # ~id ascends where the id descends
    key, tie = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))).alias("key"), F.xxhash64(text_or_empty())
    ranges = Ranges.of(documents.select(key), shuffle_width(spark))

    @F.arrow_udf("int")
    def place(keys: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(ranges.place(keys.to_numpy(), ties.to_numpy()))

    ties = (tie if ranges.splits_ids else F.lit(0).cast("long")).alias("tie")
    placed = documents.select(key, ties).select("key", place("key", "tie").alias("part"))
    heads = sorted((r["part"], r["head"]) for r in placed.groupBy("part").agg(F.min("key").alias("head")).collect())
    parts = np.array([p for p, _ in heads], np.int32)
    firsts, before = np.array([h for _, h in heads], np.int64), np.roll(parts, 1)

    @F.arrow_udf("struct<part:int,before:int>")
    def dealt(keys: pa.Array, ties: pa.Array) -> pa.Array:
        """The row's partition, and the one before it if the row may be the first there (else null)."""
        own = ranges.place(keys.to_numpy(), ties.to_numpy())
        at = np.searchsorted(parts, own)
        ahead = pa.array(before[at], mask=firsts[at] != keys.to_numpy())
        return pa.StructArray.from_arrays([pa.array(own), ahead], ["part", "before"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), key, ties).withColumn("to", dealt("key", "tie"))
    own, ghost = F.struct(F.col("to.part").alias("part"), F.lit(0).alias("ghost")), F.struct(F.col("to.before").alias("part"), F.lit(1).alias("ghost"))
    copies = F.when(F.col("to.before").isNull(), F.array(own)).otherwise(F.array(own, ghost))
    moved = rows.withColumn("copy", F.explode(copies)).select("doc_id", "text", "key", "copy.part", "copy.ghost").repartitionById(ranges.parts, F.col("part"))
    return moved.sortWithinPartitions("ghost", "key", F.xxhash64("text")).select("doc_id", "text", "ghost")


def fingerprint_documents(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []

        def emit(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            """All rows but the last, which only follows."""
            texts = [t for _, t in rows]
            changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
            own = winnow(pa.array(texts, pa.large_string()), gram, window)
            new = winnow(pa.array(changed, pa.large_string()), gram, window)
            sets = [np.unique(h) for h, _ in own]
            cols = [
                [d for d, _ in rows[:-1]],
                [len(t) for t in texts[:-1]],
                [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                [to_string(*f) for f in own[:-1]],
                [to_string(*f) for f in new],
                [likeness(a, np.unique(b)) for a, (b, _) in zip(sets, new, strict=False)],
                [likeness(a, b) for a, b in zip(sets[:-1], sets[1:], strict=True)],
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_ROWS.names)

        followed = False
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for d, t, ghost in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("ghost").to_pylist(), strict=True):
                    if not followed:
                        held.append((d, t))
                    followed = followed or bool(ghost)
                if len(held) > 1:
                    yield emit(held)
                    held = held[-1:]

    return in_descending_order(documents).mapInArrow(task("winnow")(run), _ROWS)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
