"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Largest inner product is turned into least distance: each vector gets one more component,
sqrt(M^2 - |x|^2) with M the largest norm of the table, and queries a zero. Vectors are dealt to
lists by their nearest k-means centroid. Within a probed list the randomly rotated vectors are read
in blocks of columns; after d of D columns the partial squared distance times D/d estimates the
whole one, and a candidate is abandoned as soon as the hypothesis that it belongs to the nearest k
is rejected: estimate > bound * (1 + epsilon / sqrt(d))^2. The bound of a query is its (k + k/2)-th
nearest distance within the fitted sample, which cannot be less than the true k-th: if a test errs,
others are left to make up k. Survivors are scored on the original vectors in double precision. Only
what the scan finds is returned: the sample gives bounds, never rows. A query that is left with fewer
than k rows, though there are more vectors, is scanned again through all lists without a bound.

Centroids, the number of probed lists (least that finds ``recall`` of the sample's own neighbours; more
for a query whose lists hold no k others of the sample, if there are so many) and the bounds come from the at most ``sample`` vectors of least xxhash64(vec_id); every row is
indexed. A list longer than ``chunk`` is dealt out in chunks by vec_id, each scanned by its own
task group, so a vector that a third of all rows repeat is no hot spot.

Vectors that are null, zero, hold null or non-finite components, have another length than most of
the sample, or have a null vec_id take no part. If a vec_id repeats, its least vector (in array
order) stands for it. Ties go to the smaller vec_id. Without queries or candidates there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .memory import task


@dataclass
class Index:
    """What every task knows; its size depends on the sample alone."""

    dims: int
    top: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    sizes: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    k: int
    total: int = 0

    def bare(self) -> Index:
        """Without the sample, for tasks that need only rotation and centroids."""
        return replace(self, sample_ids=self.sample_ids[:0], sample=self.sample[:0])

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0))
        return np.column_stack((x, rest))

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (self.augmented(x) @ self.rotation).astype(np.float32)

    def rotated_queries(self, q: np.ndarray) -> np.ndarray:
        return (np.column_stack((q, np.zeros(len(q)))) @ self.rotation).astype(np.float32)

    def bounds(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distance to the (k + k/2)-th nearest vector of the sample, the query's own row left out; infinite if
        the sample has not so many."""
        n = min(self.k + self.k // 2, len(self.sample))
        bound = np.full(len(q), np.inf)
        for lo in range(0, len(q), 256):
            part = q[lo : lo + 256]
            scores = part @ self.sample.T
            scores[ids[lo : lo + 256, None] == self.sample_ids[None, :]] = -np.inf
            top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            real = np.isfinite(np.take_along_axis(scores, top, axis=1))
            exact = products(part[:, None, :], self.sample[top])
            enough = real.all(axis=1) & (n == self.k + self.k // 2)
            worst = np.where(enough, np.where(real, exact, np.inf).min(axis=1), -np.inf)
            bound[lo : lo + 256] = (part**2).sum(axis=1) + self.top**2 - 2 * worst
        return bound

    def lists(self, q: np.ndarray) -> list[np.ndarray]:
        """The lists that each query looks into, nearest first."""
        near = np.argsort(_distances(np.column_stack((q, np.zeros(len(q)))), self.centroids), axis=1, kind="stable").astype(np.int32)
        held = np.cumsum(self.sizes[near], axis=1)  # the query itself may be one of them
        n = np.maximum(self.probes, (held <= self.k).sum(axis=1) + 1)
        return [row[:m] for row, m in zip(near, n.tolist(), strict=True)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, always added in the same order: equal vectors score equally to the bit."""
    return np.ascontiguousarray(a * b).sum(axis=-1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]


def k_means(x: np.ndarray, n_lists: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), n_lists, replace=False)].copy()
    for _ in range(rounds):
        nearest = _distances(x, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=n_lists)
        some = counts > 0
        centroids[some] = sums[some] / counts[some, None]
    return centroids


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part, one a vec_id."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    if embeddings.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows


def fit(vectors: DataFrame, k: int = 20, sample: int = 16_384, recall: float = 0.97, max_lists: int = 128, seed: int = 11) -> Index | None:
    """None for a table without usable vectors."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().to_pydict()
    if not rows["vec_id"]:
        return None
    lengths = np.array([len(v) for v in rows["v"]])
    dims = int(np.bincount(lengths).argmax())
    same = lengths == dims
    ids = np.array(rows["vec_id"], np.int64)[same]
    x = np.array([v for v, ok in zip(rows["v"], same, strict=True) if ok])
    sized = vectors.filter(F.size("v") == dims)
    top, total = sized.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))), F.count("*")).first()
    top = float(top) * (1 + 1e-9)
    rng = np.random.Generator(np.random.PCG64(seed))
    rotation = np.linalg.qr(rng.standard_normal((dims + 1, dims + 1)))[0]
    index = Index(dims, top, rotation, np.empty((0, dims + 1)), 1, np.empty(0, np.int64), ids, x, k, total)
    full = index.augmented(x)
    n_lists = int(min(max_lists, max(1, len(x) ** 0.5)))
    index.centroids = k_means(full, n_lists, 8, rng)
    # rank of the list of each true neighbour among the lists as the query sees them
    home = _distances(full, index.centroids).argmin(axis=1)
    index.sizes = np.bincount(home, minlength=n_lists)
    at = rng.choice(len(x), min(256, len(x)), replace=False)
    scores = x[at] @ x.T
    scores[np.arange(len(at)), at] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    seen = np.column_stack((x[at], np.zeros(len(at))))
    rank = np.empty((len(at), n_lists), np.int64)
    np.put_along_axis(rank, np.argsort(_distances(seen, index.centroids), axis=1), np.arange(n_lists)[None, :], axis=1)
    places = np.sort(np.take_along_axis(rank, home[near], axis=1).ravel())
    index.probes = int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1 if len(places) else n_lists
    return index


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def assign(vectors: DataFrame, index: Index) -> DataFrame:
    """vec_id, v, list."""
    index = index.bare()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = index.augmented(_matrix(batch.column("v"), index.dims))
            home = np.concatenate([_distances(x[a : a + 1024], index.centroids).argmin(axis=1) for a in range(0, len(x), 1024)] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(home.astype(np.int32))], names=["vec_id", "v", "list"])

    return vectors.filter(F.size("v") == index.dims).select("vec_id", "v").mapInArrow(task("vectors")(run), "vec_id long, v array<double>, list int")


def probe(queries: DataFrame, index: Index) -> DataFrame:
    """vec_id, v, bound, lists (those that each query looks into)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("v"), index.dims)
            bound = index.bounds(batch.column("vec_id").to_numpy(), q)
            lists = pa.array(index.lists(q), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(bound), lists], names=["vec_id", "v", "bound", "lists"])

    return queries.filter(F.size("v") == index.dims).select("vec_id", "v").mapInArrow(task("vectors")(run), "vec_id long, v array<double>, bound double, lists array<int>")


def scan_block(data: np.ndarray, queries: np.ndarray, bounds: np.ndarray, top: float, width: int = 16, epsilon: float = 2.1) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that survive the adaptive scan of rotated vectors, ``width`` columns at a time."""
    total = data.shape[1]
    slack = (bounds * (1 + 1e-5) + 4e-6 * top**2).astype(np.float32)  # what single precision may lose
    part = _distances(queries[:, :width], data[:, :width])
    q, r = np.nonzero(part * (total / min(width, total)) <= (slack * (1 + epsilon / min(width, total) ** 0.5) ** 2)[:, None])
    part = part[q, r]
    for lo in range(width, total, width):
        hi = min(lo + width, total)
        part = part + ((queries[q, lo:hi] - data[r, lo:hi]) ** 2).sum(axis=1)
        factor = 1.0 if hi == total else (1 + epsilon / hi**0.5) ** 2
        keep = part * (total / hi) <= slack[q] * factor
        q, r, part = q[keep], r[keep], part[keep]
    return q, r


_FOUND = "query_id long, vec_id long, score double"


def scan(blocks: DataFrame, index: Index, n_queries: int = 64) -> DataFrame:
    """From rows (list, chunk, bound, vec_id, v) sorted with the vectors (null bound) of a block before its queries:
    the k best of each query in the block."""
    index = index.bare()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, data, ids, rotated, waiting = None, [], [], None, []

        def answer() -> pa.RecordBatch | None:
            nonlocal rotated
            if not data or not waiting:
                waiting.clear()
                return None
            if rotated is None:
                data[:] = [np.concatenate(data)]
                ids[:] = [np.concatenate(ids)]
                rotated = index.rotated(data[0])
            own = np.array([w[0] for w in waiting])
            q = np.array([w[2] for w in waiting])
            a, r = scan_block(rotated, index.rotated_queries(q), np.array([w[1] for w in waiting]), index.top)
            waiting.clear()
            other = own[a] != ids[0][r]
            a, r = a[other], r[other]
            score = products(q[a], data[0][r])
            order = np.lexsort((ids[0][r], -score, a))
            a, r, score = a[order], r[order], score[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            keep = rank < index.k
            return pa.RecordBatch.from_arrays([pa.array(own[a[keep]]), pa.array(ids[0][r[keep]]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            place = (batch.column("list").to_numpy().astype(np.int64) << 32) | batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if place[lo] != at:
                    if waiting and (got := answer()) is not None:
                        yield got
                    at, rotated = place[lo], None
                    data.clear()
                    ids.clear()
                asks = part.column("bound").is_valid().to_numpy(zero_copy_only=False)
                v, own = _matrix(part.column("v"), index.dims), part.column("vec_id").to_numpy()
                if not asks.all():
                    data.append(v[~asks])
                    ids.append(own[~asks])
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(asks):
                    waiting.append((own[i], bound[i], v[i]))
                    if len(waiting) >= n_queries and (got := answer()) is not None:
                        yield got
        if waiting and (got := answer()) is not None:
            yield got

    return blocks.mapInArrow(task("vectors")(run), _FOUND)


def search(embeddings: DataFrame, is_query, k: int = 20, chunk: int = 4096, **how) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row for which ``is_query`` holds."""
    vectors = usable(embeddings)
    index = fit(vectors, k, **how)
    if index is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = assign(vectors, index)
    # a row a list, at most max_lists: may be broadcast
    chunks = F.broadcast(placed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(float(chunk))).cast("int").alias("chunks")))
    rows = placed.join(chunks, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(None).cast("double").alias("bound"), "vec_id", "v")

    def answers(queries: DataFrame) -> DataFrame:
        asked = queries.withColumn("list", F.explode("lists")).join(chunks, "list")
        asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "bound", "vec_id", "v")
        blocks = rows.unionByName(asked).repartition("list", "chunk").sortWithinPartitions("list", "chunk", F.col("bound").asc_nulls_first())
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = scan(blocks, index).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return found.select("query_id", "rank", "vec_id", "score")

    queries = vectors.filter(is_query).filter(F.size("v") == index.dims)
    found = materialize(answers(probe(queries, index)), "nearest")
    full = found.groupBy("query_id").count().filter(F.col("count") >= min(k, index.total - 1)).select(F.col("query_id").alias("vec_id"))
    short = materialize(queries.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    every = short.select("vec_id", "v", F.lit(float("inf")).alias("bound"), F.sequence(F.lit(0), F.lit(len(index.centroids) - 1)).alias("lists"))
    again = answers(every)
    return found.join(short, found.query_id == short.vec_id, "left_anti").unionByName(again)


def op3_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
