from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import bitpack, winnow
from inkgrid.llm.common import scratch_path, vocabulary_path
from inkgrid.llm.ranges import Ranges


def test_places_keep_the_order_and_split_a_common_id():
    ranges = Ranges(np.array([3, 7, 7, 7, 7, 20]))
    rng = np.random.default_rng(4)
    keys = rng.choice([1, 3, 7, 8, 20, 30], 5000, p=[0.1, 0.1, 0.5, 0.1, 0.1, 0.1])
    ties = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    place = ranges.place(keys, ties)
    order = np.lexsort((ties, keys))
    assert (np.diff(place[order]) >= 0).all() and place.max() < ranges.parts and ranges.splits_ids
    sizes = np.bincount(place[keys == 7])
    assert np.count_nonzero(sizes) == 4 and sizes.max() < 800
    assert not Ranges(np.array([3, 7])).splits_ids and Ranges(np.empty(0, np.int64)).parts == 1


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of the rows under one doc_id, a third without one."""
    rows = [(i, f"own text {i} " * (i % 5)) for i in range(40)] + [(17, f"shared id {i}") for i in range(40)] + [(None, f"no id {i}") for i in range(40)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_descending_neighbours_when_one_id_is_common(spark, crowded):
    rows, df = crowded
    tie = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = sorted((repr(d), len(t), hashlib.sha256(winnow.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order))
    dealt = winnow.in_descending_order(df).filter("ghost = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) > 1 and sum(r["count"] for r in dealt) == len(rows)
    got = sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in winnow.fingerprint_documents(df).collect())
    assert got == want


def test_written_ids_when_one_id_is_common(spark, crowded):
    rows, df = crowded
    path = scratch_path(spark, "test-ranges")
    bitpack.write_shards(df, path, vocabulary_path("word_bpe_49k.json"), bitpack.WORD_BPE_IDS, bitpack.END_ID, shard_ids=64, block_ids=16)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in bitpack.read_documents(spark, path).collect())
    assert [s for s, _, _ in got] == [sum(n for _, _, n in got[:i]) for i in range(len(got))]
    ids = [-1 if d is None else d for _, d, _ in got]
    assert ids == sorted(ids) and len(ids) == len(rows)
    assert bitpack.read_ids(spark, path, 0, 10**9).size == sum(n for _, _, n in got)
