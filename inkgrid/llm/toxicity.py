"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the presence of character n-grams (3 to 7 code points, lower case, everything but
letters read as one blank) hashed to 2^22 buckets. Each is scaled by its smoothed log-count ratio
between toxic and other training texts; a logistic regression is trained on the scaled features.
Features whose ratio is within its sampling error (|z| below ``min_z``) are not used: in long texts
thousands of chance n-grams would add up.

Training reads at most ``max_per_class`` labelled texts of each class, those of the least
xxhash64(doc_id); the classes are weighted back to their shares among all labels. Scores are
computed from the whole text alone. Null text is an empty text and gets the score of one. Labels
that are null, neither 0 nor 1, or contradict each other for one doc_id are not learnt from. With
labels of one class only, or none, every score is the share of toxic labels (0 without labels).
A null doc_id is scored, and counts as not held out.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, text_or_empty
from .memory import task, trim
from .textkit import mix, powers, prefix_hash

ORDERS = (3, 4, 5, 6, 7)
BUCKET_BITS = 22
#: Characters handled at once.
_CHUNK = 1 << 17


def _letters() -> np.ndarray:
    """Code of each code point below 2^16: itself if a letter, else a blank."""
    codes = np.arange(1 << 16, dtype=np.uint64)
    is_letter = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
    codes[~is_letter] = 32
    return mix(codes + np.uint64(1))


_code_table: list[np.ndarray] = []


def _features(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(order, bucket of the gram at each place) over the joined texts; the caller drops grams across two texts."""
    if not _code_table:
        _code_table.append(_letters())
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _code_table[0][np.minimum(points, 0xFFFF)]
    prefix = prefix_hash(codes)
    for k in ORDERS:
        n = len(prefix) - k
        if n > 0:
            yield k, (((prefix[k:] - prefix[:n]) * powers(n)[1] * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about _CHUNK characters, each text between blanks."""
    lo, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(f" {t} ")
        size += len(t) + 2
        if size >= _CHUNK:
            yield lo, held
            lo, held, size = i + 1, [], 0
    if held:
        yield lo, held


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct features of every text; with ``wanted`` (flag a bucket) only of those."""
    found = []
    for first, run in _runs(texts):
        ends = np.cumsum([len(t) for t in run])
        own = []
        for k, bucket in _features(run):
            at = np.flatnonzero(wanted[bucket]) if wanted is not None else np.arange(len(bucket))
            row = np.searchsorted(ends, at, side="right") if wanted is not None else np.repeat(np.arange(len(run)), np.diff(ends, prepend=0))[: len(at)]
            inside = at + k <= ends[row]
            own.append(((row[inside] + first) << BUCKET_BITS) | bucket[at[inside]])
        both = np.concatenate(own) if own else np.empty(0, np.int64)
        both.sort()
        found.append(both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both)
    both = np.concatenate(found) if found else np.empty(0, np.int64)
    return both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)


@dataclass
class Model:
    """Weight of each chosen bucket (ratio times learnt coefficient) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self):
        wanted = np.zeros(1 << BUCKET_BITS, bool)
        wanted[self.buckets] = True

        def score(texts: list[str]) -> np.ndarray:
            rows, buckets = present(texts, wanted)
            margin = np.bincount(rows, self.weights[np.searchsorted(self.buckets, buckets)], len(texts)) + self.intercept
            return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

        return score


#: Pairs of text and feature that one step of training holds unpacked.
AT_ONCE = 1 << 20


def train_logistic(columns: np.ndarray, offsets: np.ndarray, scale: np.ndarray, target: np.ndarray, sample_weight: np.ndarray, l2: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by Adam over the whole sparse matrix: row i has the features ``columns[offsets[i]:offsets[i+1]]``,
    each with the value ``scale`` of its column. Rows are unpacked a block at a time, so memory is that of ``columns``."""
    n_columns, n = len(scale), len(target)
    w, b = np.zeros(n_columns), 0.0
    m, v = np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    share = sample_weight / sample_weight.sum()
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + AT_ONCE, side="right")) - 1))
    for t in range(1, steps + 1):
        scaled, gradient, bias = w * scale, np.zeros(n_columns), 0.0
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = columns[offsets[lo] : offsets[hi]]
            rows = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(offsets[lo : hi + 1]))
            margin = np.bincount(rows, scaled[own], hi - lo) + b
            wrong = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - target[lo:hi]) * share[lo:hi]
            gradient += np.bincount(own, wrong[rows], n_columns)
            bias += wrong.sum()
        g = np.append(gradient * scale + l2 * w / n_columns**0.5, bias)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, y of the labels that may be learnt from: one agreed 0/1 label a document, fold not held out."""
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    kept = kept.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    return kept.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_top")).filter("y = _top").drop("_top")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_per_class: int = 4000, max_features: int = 20_000, min_z: float = 2.5, min_texts: int = 3, max_pairs: int = 16_000_000) -> Model:
    """Learn from a bounded sample. The driver gets the sample's size in ids, ``max_features`` ratios and
    the sample's chosen features: at most ``max_pairs`` pairs of text and feature (4 bytes each), half for
    each class. A sample of long texts that has more is cut in the order of xxhash64(doc_id)."""
    spark = documents.sparkSession
    usable = training_labels(labels)
    shares = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        share = (shares.get(1, 0) / total) if total else 0.0
        edge = 500.0 if share else -500.0
        return Model(np.empty(0, np.int64), np.empty(0), edge)
    chosen = None
    for y in (0, 1):
        part = usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = spark.createDataFrame([(r["doc_id"], r["y"]) for r in chosen.collect()], "doc_id long, y int")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_or_empty()).alias("text"))
    sample = materialize(texts.join(F.broadcast(picked), "doc_id"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                y = np.array(part.column("y").to_pylist())
                rows, buckets = present(part.column("text").to_pylist())
                for c in (0, 1):
                    np.add.at(seen[c], buckets[y[rows] == c], 1)
        at = np.flatnonzero(seen.any(axis=0))
        for lo in range(0, len(at), 1 << 16):
            a = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(seen[0, a].astype(np.int64)), pa.array(seen[1, a].astype(np.int64))], names=["bucket", "clean", "toxic"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log((shares[1] + 0.5) / (shares[0] + 0.5))))
    counts = sample.mapInArrow(task("toxicity")(count), "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n0 + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    ranked = counts.select("bucket", ratio.alias("ratio"), (ratio / error).alias("z"), (F.col("toxic") + F.col("clean")).alias("n"))
    best = ranked.filter((F.abs("z") >= min_z) & (F.col("n") >= min_texts)).orderBy(F.desc(F.abs("z")), "bucket").limit(max_features).select("bucket", "ratio").toArrow()
    prior = float(np.log((shares[1] + 0.5) / (shares[0] + 0.5)))
    buckets = best.column("bucket").to_numpy().astype(np.int64)
    ratios = best.column("ratio").to_numpy()
    if not len(buckets):
        return Model(buckets, ratios, prior)
    order = np.argsort(buckets)
    buckets, ratios = buckets[order], ratios[order]

    def chosen_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BUCKET_BITS, bool)
        wanted[buckets] = True
        for batch in batches:
            rows, found = present(batch.column("text").to_pylist(), wanted)
            column = np.searchsorted(buckets, found).astype("<u4")
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            packed = [column[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(np.diff(cut)), pa.array(packed, pa.binary())], names=["doc_id", "y", "n", "features"])

    # at most max_per_class rows a class are in the window
    featured = materialize(sample.mapInArrow(task("toxicity")(chosen_features), "doc_id long, y int, n long, features binary"), "toxicity-features")
    so_far = F.sum("n").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features")).rowsBetween(Window.unboundedPreceding, 0))
    running = featured.select("doc_id", "y", "features", so_far.alias("so_far"), F.col("n"))
    # the first text of a class stays however long it is: it has max_features pairs at most
    matrix = running.filter((F.col("so_far") <= max_pairs // 2) | (F.col("so_far") == F.col("n"))).select("doc_id", "y", "features").toArrow().sort_by("doc_id")
    y = matrix.column("y").to_numpy().astype(float)
    features = matrix.column("features")
    offsets = np.concatenate(([0], np.cumsum([len(x.as_buffer()) // 4 for x in features])))
    columns = np.empty(offsets[-1], np.uint16 if len(buckets) <= 1 << 16 else np.uint32)
    for i, x in enumerate(features):
        columns[offsets[i] : offsets[i + 1]] = np.frombuffer(x.as_buffer(), "<u4")
    del matrix, features
    weight = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum()))
    w, b = train_logistic(columns, offsets, ratios, y, weight)
    del columns
    gc.collect()  # the driver gives back what training took: later stages need the room
    trim()
    return Model(buckets, w * ratios, b)


def score_texts(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score``, from the column ``_lower`` (lower-case text)."""
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = score(part.column("_lower").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(got, pa.float64())], names=schema.names)

    return documents.select(*keep, "_lower").mapInArrow(task("toxicity")(run), schema)


def with_scores(documents: DataFrame, labels: DataFrame, keep: list[str], **how) -> DataFrame:
    model = fit(documents, labels, **how)
    return score_texts(documents.withColumn("_lower", F.lower(text_or_empty())), model, keep)


def op7_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = with_scores(documents, table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
