from __future__ import annotations

import random
from collections import Counter

import numpy as np

from inkgrid.llm import ngram_join as J
from inkgrid.llm.components import components

from .conftest import DOCUMENTS, sentence


def shingles(text: str) -> frozenset:
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows: list[tuple[int, str]]) -> dict[int, tuple[int, int, int]]:
    """doc_id -> class, links to other sets, copies."""
    own = {d: shingles(t) for d, t in rows}
    first = {}
    for d in sorted(own):
        first.setdefault(own[d], d)
    sets = [s for s in first if s]
    label = {s: first[s] for s in sets}
    links = Counter()
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[:i] if len(a & b) >= 0.8 * len(a | b) - 1e-12]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    copies = Counter(own.values())
    return {d: (label[s], links[s], copies[s]) if s else (d, 0, 1) for d, s in own.items()}


def family(seed: int, n: int, edits: int, words: int = 200) -> list[str]:
    rng, base = random.Random(seed), sentence(seed, words).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def run(spark, rows, **how):
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **how).collect()
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in got}


def test_equals_brute_force(spark):
    texts = [t for s in range(4) for t in family(s, 12, 5)] + [sentence(s, 50) for s in range(20, 30)] + ["one two", "one two", "one two three four five", ""]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    assert run(spark, rows) == brute(rows)


def test_blocks_lose_no_link(spark):
    """A class over many blocks has the links and the class it has in one."""
    rows = list(enumerate(family(5, 60, 6)))
    assert run(spark, rows, block=7) == brute(rows)


def test_depth_shortens_until_the_recall_is_reached():
    depth = J.shortened_depth(0.8, 0.999, 16, 8)
    assert J.recall_at(0.8, depth, 16) >= 0.999 > J.recall_at(0.8, depth + 1, 16)
    assert J.shortened_depth(1.0, 0.999, 16, 8) == 8
    assert J.least_partnered(0.8) == 4


def test_crowded_tries_stay_as_deep_as_the_recall_allows():
    how = (0.8, 0.999, 20, 5, 8)
    for crowded in range(21):
        depth, n = J.crowded_depths(crowded, *how)
        missed = (1 - 0.8**5) ** (20 - crowded) * (1 - 0.8**depth) ** n * (1 - 0.8 ** (depth + 1)) ** (crowded - n)
        assert missed <= 0.001 and 5 <= depth < 8
        if n:
            assert missed * (1 - 0.8 ** (depth + 1)) / (1 - 0.8**depth) > 0.001, "one prefix less shortened would miss too many"
    assert J.crowded_depths(2, *how)[0] == 7 and J.crowded_depths(20, *how)[0] == 5


def test_crowded_tries_lose_no_link(spark):
    """Trie nodes of over ``leaf`` members, with prefixes of several depths."""
    rows = list(enumerate(t for s in (41, 42) for t in family(s, 60, 4)))
    assert run(spark, rows, leaf=4) == brute(rows)


def chain(n: int, words: int = 120, step: int = 16) -> list[tuple[int, str]]:
    """Overlapping texts: neighbours share three quarters of their shingles, none 0.8 of their union."""
    base = sentence(77, words + step * n).split()
    return [(i, " ".join(base[i * step : i * step + words])) for i in range(n)]


def test_a_chain_is_compared_trie_node_by_trie_node(spark):
    rows = chain(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = J.sign(docs, 5, 20, 5, 8, 4).withColumnRenamed("doc_id", "node")
    members = J.trie_nodes(signed, 0.8, 0.999, 20, 5, 8, 64)
    largest = members.groupBy("cell").count().agg({"count": "max"}).first()[0]
    groups = J.candidate_groups(members, True).groupBy("grp", "tree").count().agg({"count": "max"}).first()[0]
    chained = components(members.selectExpr("node AS a", "hub AS b")).groupBy("root").count().agg({"count": "max"}).first()[0]
    assert groups <= max(largest, 6) < chained
    assert run(spark, rows) == brute(rows)


def test_links_met_in_several_trees_count_once(spark):
    """Copies with edits along a chain: groups by trie node, links and classes as by brute force."""
    rows = chain(60)
    rows += [(100 + i, t.replace(t.split()[50], "edited", 1)) for i, t in rows[::3]]
    assert run(spark, rows) == brute(rows)


def test_recall_by_similarity(spark):
    """Edited copies from 0.8 up: found links by bin of similarity."""
    rows, rng = [], random.Random(9)
    for s in range(150):
        base = sentence(1000 + s, 150).split()
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
        rows += [(2 * s, " ".join(base)), (2 * s + 1, " ".join(own))]
    got = run(spark, rows)
    bins: dict[int, list[bool]] = {}
    for s in range(150):
        a, b = shingles(rows[2 * s][1]), shingles(rows[2 * s + 1][1])
        j = len(a & b) / len(a | b)
        if j >= 0.8:
            bins.setdefault(int(j * 20), []).append(got[2 * s + 1][0] == 2 * s)
    assert len(bins) >= 3 and all(sum(x) / len(x) >= 0.9 for x in bins.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 103: 100}


def test_links_of_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(25)]
    got = J._links(sets, 0, 0.5)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == (i != j and len(set(a) & set(b)) >= 0.5 * len(set(a) | set(b)))


def test_odd_rows(spark, odd_dir, empty_dir):
    got = J.op1_ngram_jaccard_join(spark, odd_dir).collect()
    assert len(got) == len(DOCUMENTS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["class_id"], r["n_links"] > 0, r["n_copies"]))
    assert by[1] == by[5] == {(1, True, 3)} and by[14] == {(1, True, 1)}
    assert by[2] == {(2, False, 1)} and by[3] == {(3, False, 1)} and by[10] == {(10, False, 1)}
    assert by[None] == {(None, False, 1)}
    assert J.op1_ngram_jaccard_join(spark, empty_dir).count() == 0
