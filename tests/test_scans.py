from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.functions import geometry as G
from inkgrid.operators import generators, graphs, ordering, scans, statistics
from inkgrid.sources import readers, writers
from inkgrid.streaming import regions


def test_running_totals_of_a_key_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 10 else None if i % 20 else "cold", i, rng.randint(-3, 9)) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, i int, v int").withColumns({c: F.lit("x") for c in ("_p", "n")}).repartition(7)
    got = {r["i"]: (r["before"], r["top"]) for r in scans.running_states(frame, ["k"], [F.col("i")], {"before": (F.col("v"), "sum"), "top": (F.col("v"), "max")}).collect()}
    seen = defaultdict(list)
    for k, i, v in rows:
        assert got[i] == ((sum(seen[k]), max(seen[k])) if seen[k] else (None, None))
        seen[k].append(v)
    assert scans.running_totals(frame.filter("false"), ["k"], [F.col("i")], {"t": F.col("v")}).count() == 0


def test_groups_by_their_first_row(spark):
    """A row opens a group if it is 10 or more beyond the group's first row: no comparison of neighbours can say so."""
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(6):
        first, group, at = None, -1, 0
        for i in range(60):
            at += rng.randint(0, 6)
            if first is None or at - first >= 10:
                first, group = at, group + 1
            rows.append((k, i, at))
            want[k, i] = group
    frame = spark.createDataFrame(rows, "k int, i int, at int")
    found = scans.first_bound_groups(frame, ["k"], [F.col("i")], lambda c, first: c["at"] - first["at"] >= 10, F.struct("at"))
    assert {(r["k"], r["i"]): r["group"] for r in found.collect()} == want


def test_merged_lines_equal_the_fold(spark):
    rng = random.Random(2)
    rows = [(k, i, (float(rng.randint(0, 50)), float(rng.randint(0, 120)), 10.0, float(rng.choice([0, 3, 10, 20, 60])))) for k in range(20) for i in range(rng.randint(1, 14))]
    frame = spark.createDataFrame(rows, f"k int, i int, b {G.BOX}")
    got = Counter(r["k"] for r in ordering.merged_lines(frame, ["k"]).collect())
    fold = frame.filter("b.h > 0").groupBy("k").agg(F.collect_list("b").alias("b")).select("k", ordering.independent_lines(F.col("b")).alias("n"))
    assert got == {r["k"]: r["n"] for r in fold.collect()}


def test_lines_of_characters(spark):
    def char(i, ch, x, y, w=5.0, h=10.0):
        return (1, i, ch, (float(x), float(y), w, h))

    rows = [char(0, " ", 0, 0), char(1, "a", 0, 0), char(2, " ", 5, 1), char(3, " ", 6, 30), char(4, "b", 10, 4), char(5, "c", 8, 9), char(6, "d", 0, 30), char(7, "e", 0, 30), char(8, "f", 9, 0)]
    got = [(r["line"], r["text"], r["chars"], r["violations"]) for r in ordering.lines_of_characters(spark.createDataFrame(rows, f"k int, i int, ch string, b {G.BOX}"), ["k"], "i").orderBy("line").collect()]
    # c is 9 below a, more than half a height, though only 5 below b: the first character decides
    assert got == [(0, "a b", 2, 0), (1, "c", 1, 0), (2, "de", 2, 1), (3, "f", 1, 0)]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_lines_of_chunks(spark, size):
    rng = random.Random(size)
    texts = {"a": "".join(rng.choice("xy é\n\n ") for _ in range(400)), "b": "no newline at all " * 20, "c": "\n\n\n", "d": "end\n"}
    rows = [(k, i, t[i : i + size]) for k, t in texts.items() for i in range(0, len(t), size)] + [("a", 10**6, None), ("b", 10**6, "")]
    got = defaultdict(list)
    for r in regions.lines_of_chunks(spark.createDataFrame(rows, "k string, n int, t string").repartition(5), ["k"], ["n"], "t").orderBy("k", "line").collect():
        assert r["line"] == len(got[r["k"]])
        got[r["k"]].append(r["content"])
    assert got == {k: lines for k, t in texts.items() if (lines := [x for x in t.split("\n") if x.strip(" ")])}


def test_lines_of_chunks_are_cut_where_their_range_is(spark):
    """the text is shuffled by its range only, no line or piece by its number; keys of any kind, one of them null."""
    rows = [(k, 0.5, i, t) for k in (None, 3, 4) for i, t in enumerate(["a\nb", "c", "\n \n", "d\n\ne", "f"] * 30)]
    found = regions.lines_of_chunks(spark.createDataFrame(rows, "k long, x double, n int, t string").repartition(3), ["k", "x"], ["n"], "t")
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = [x for x in ("a\nbc\n \nd\n\nef" * 30).split("\n") if x.strip(" ")]
    for k in (None, 3, 4):
        assert [r["content"] for r in sorted((r for r in found.collect() if r["k"] == k), key=lambda r: r["line"])] == want
    assert regions.lines_of_chunks(spark.createDataFrame([], "k long, n int, t string"), ["k"], ["n"], "t").count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 20)] + [(500, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in graphs.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(20)}, 500: 500}


def test_jackknife_of_mergeable_statistics(spark):
    rng = random.Random(4)
    rows = [(c, i, rng.randint(0, 9), rng.randint(1, 9)) for c, n in (("a", 40), ("b", 1), ("c", 2)) for i in range(n)]
    frame = spark.createDataFrame(rows, "c string, i int, x long, y long")
    plain = {"sum": lambda v: sum(x for x, _ in v), "max": lambda v: max(x for x, _ in v), "ratio": lambda v: sum(x for x, _ in v) / sum(y for _, y in v), "correlation": lambda v: float(np.corrcoef(*zip(*v))[0, 1]) if len(v) > 1 else None}
    for name, statistic in plain.items():
        got = {(r["c"], r["i"]): r["without"] for r in statistics.jackknife(frame, ["c"], ["i"], *statistics.mergeable(name, F.col("x"), F.col("y"))).collect()}
        for c, i, _, _ in rows:
            others = [(x, y) for d, j, x, y in rows if d == c and j != i]
            want = statistic(others) if others else None
            assert got[c, i] == (pytest.approx(want) if want is not None else None), (name, c, i)
    with pytest.raises(ValueError):
        statistics.mergeable("median", F.col("x"), F.col("y"))


def test_resample_of_a_large_stratum(spark, monkeypatch):
    monkeypatch.setattr(generators, "LEAF", 32)
    frame = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 501 == 0, None).otherwise("large").alias("s"))
    drawn = generators.resample(frame, "s", "id", 5).collect()
    again = generators.resample(frame.repartition(11), "s", "id", 5).collect()
    assert sorted(map(repr, drawn)) == sorted(map(repr, again))
    assert sorted(map(repr, drawn)) != sorted(map(repr, generators.resample(frame, "s", "id", 6).collect()))
    sizes = {r["s"]: r["n"] for r in frame.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert Counter(r["s"] for r in drawn) == sizes
    assert all((r["s"] == "small") == (r["id"] % 10 == 0) for r in drawn)
    times = np.array([Counter(r["id"] for r in drawn).get(i, 0) for i in range(4000)])
    # a share of e^-1 is never drawn, and the counts have the variance of a multinomial one
    assert abs((times == 0).mean() - np.exp(-1)) < 0.03 and abs(times.var() - 1) < 0.15
    halves = np.array([sum(1 for r in generators.resample(frame, "s", "id", k).collect() if r["id"] < 2000) for k in range(3)])
    assert halves.std() > 3  # the split itself is drawn, not fixed


def test_sitemap(spark, tmp_path):
    rows = [(f"https://x/{i}?a=1&b=<{i}>", "2026-01-01" if i % 2 else None, None, "0.5", [("en", 'q"uote'), ("de", "ü")][: i % 3]) for i in range(25)] + [(None, None, None, None, None), ("https://x/z", None, None, None, None)]
    writers.sitemap(spark.createDataFrame(rows, "loc string, lastmod string, changefreq string, priority string, alternates array<struct<hreflang:string,href:string>>"), str(tmp_path / "s"), per_file=10)
    files = sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir())
    assert files == ["file=0", "file=1", "file=2"]
    import xml.etree.ElementTree as ET

    counts = []
    for f in files:
        (part,) = (tmp_path / "s" / f).glob("part-*")
        counts.append(len(ET.parse(part).getroot()))
    assert counts == [10, 10, 6]
    back = {r["loc"]: r for r in readers.sitemap(spark, str(tmp_path / "s")).collect()}
    for loc, lastmod, freq, priority, alternates in rows:
        if loc:
            assert (back[loc]["lastmod"], back[loc]["changefreq"], back[loc]["priority"], [tuple(a) for a in back[loc]["alternates"]]) == (lastmod, freq, priority, alternates or [])
