from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkgrid.llm.prefix_trie import numbered_turns, op13_prefix_trie, prefix_trie, subtree_sums

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plainly(rows):
    """The contract by tuples and loops."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        gain = (len(convs) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += gain
    out = []
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(path))))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(parts)


def same(got, rows):
    assert sorted(map(repr, map(tuple, got.select(*COLUMNS).collect()))) == sorted(map(repr, plainly(rows)))


def made(seed, n, longest, words=("a", "b", "", None, "é日😀"), ids=300):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(ids), n):
        size = rng.randint(1, longest)
        turns = rng.choices([None, *range(size)], k=size) if rng.random() < 0.3 else range(size)
        rows += [(c, t, rng.choice(("user", "bot", None)), rng.choice(words)) for t in turns]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_trie(spark, seed):
    rows = made(seed, 120, 9)
    same(prefix_trie(table(spark, rows)), rows)


def test_one_long_conversation_is_spread_over_ranges(spark):
    rows = [(7, t, "user", f"t{t % 13}") for t in range(500)] + made(5, 40, 4)
    rows = [r for r in rows if r[0] != 7 or r[2] == "user"]
    numbered = numbered_turns(table(spark, rows)).filter("conv_id = 7")
    assert numbered.select("part").distinct().count() > 1
    assert [r["pos"] for r in numbered.orderBy("pos").collect()] == list(range(1, numbered.count() + 1))
    same(prefix_trie(table(spark, rows)), rows)


def test_copies_and_runs_of_ends(spark):
    """Thousands of copies of a conversation end in one node: its ids are hashed in order, over several runs."""
    turns = [("user", "hello"), ("bot", "hi"), ("user", "bye")]
    rows = [(c, t, r, x) for c in [*range(0, 13_000, 3), *range(99_000, 99_050)] for t, (r, x) in enumerate(turns)]
    same(prefix_trie(table(spark, rows)), rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no id"), (100, 0, "user", "x"), (100, 0, "user", "x"), (100, None, "bot", None), (100, 1, None, ""), (101, 0, "user", "y"), (101, 0, "bot", "y"), (102, 3, "user", "z" * 200_000),
        (203, 0, "user", "no base"), (299, 1, "user", "one turn"), (-5, 0, "user", "negative"), (0, None, None, None), (1, 0, "use", "rx"), (2, 0, "user", "x"),
    ]
    same(prefix_trie(table(spark, [r for r in rows if r[0] is None or r[0] >= 0])), [r for r in rows if r[0] is None or r[0] >= 0])
    assert prefix_trie(table(spark, rows)).count() > 0
    extra = table(spark, rows[:-4]).withColumns({c: F.lit("x") for c in ("node", "part", "depth", "n", "pos", "h", "up", "place")})
    same(prefix_trie(extra), rows[:-4])


def test_turnless_conversations_end_in_the_root(spark):
    short = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1][:4]
    rows = [(c, 0, "user", "x") for c in short]
    same(prefix_trie(table(spark, rows)), rows)
    assert prefix_trie(table(spark, rows)).count() == 1


def test_empty_table(spark):
    assert prefix_trie(table(spark, [])).collect() == []


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 4, 7, 8, 9])
def test_subtree_sums_of_chains_and_stars(spark, depth):
    rows = [(0, None, 0, 1)] + [(d, d - 1, d, 1) for d in range(1, depth + 1)] + ([(100 + i, depth - 1, depth, 2) for i in range(5)] if depth else [])
    nodes = spark.createDataFrame(rows, "node long, parent long, depth long, w long").withColumns({c: F.col(c).cast("string").cast("binary") for c in ("node", "parent")})
    got = {int(bytes(r["node"])): r["w"] for r in subtree_sums(nodes, ["w"], depth).collect()}
    want = {n: 0 for n, *_ in rows}
    up = {n: p for n, p, *_ in rows}
    for n, _, _, w in rows:
        while n is not None:
            want[n] += w
            n = up[n]
    assert got == want


def test_query_equals_the_trie_on_a_table(spark, tmp_path):
    rows = made(11, 60, 6)
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    same(op13_prefix_trie(spark, str(tmp_path)), rows)
