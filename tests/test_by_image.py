"""The scorer on rows of images: the same units as the joins, and no tables written on the way."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from inkgrid import plans
from inkgrid.functions import geometry as G
from inkgrid.operators import matching, ordering, scoring, tables
from inkgrid.operators.tables import shared_folder
from inkgrid.plans import standin

DATA = "/root/testdata/sf0.001"


def random_lines(spark, seed=5, images=30):
    rng = random.Random(seed)
    at = lambda: (float(rng.randint(0, 60)), float(rng.randint(0, 60)), float(rng.randint(5, 40)), float(rng.randint(5, 30)))
    gt = [(i, g, f"L{g:03d}", f"text {g}", at()) for i in range(images) for g in range(rng.randint(0, 7))]
    pred = [(i, p, f"text {p}", at(), f"text {p}", None, False) for i in range(images) for p in range(rng.randint(0, 7))]
    return spark.createDataFrame(gt, f"image_id int, g int, line_id string, text string, b {G.BOX}"), spark.createDataFrame(pred, f"image_id int, p int, text string, b {G.BOX}, normal string, dropped string, icon boolean")


def test_components_equal_union_find(spark):
    gt, pred = random_lines(spark)
    none = F.lit(None).cast("int")
    pairs = matching.overlap_join(gt.select("image_id", "g", F.col("b").alias("a")), pred.select("image_id", "p", "b"), ["image_id"], G.overlap_min(F.col("a"), F.col("b")), 0.5)
    edges = pairs.select("image_id", "g", "p").unionByName(gt.select("image_id", "g", none.alias("p"))).unionByName(pred.select("image_id", none.alias("g"), "p"))
    want: dict = {}
    for r in matching.components_by_key(edges, ["image_id"]).collect():
        want.setdefault((r["image_id"], r["component"]), set()).add((r["side"], r["node"]))
    pages = scoring.by_image(gt, pred).select("image_id", F.explode(scoring.components_in(F.col("gt"), F.col("pred"), 0.5)).alias("c"))
    got = sorted((r["image_id"], sorted([("g", n) for n in r["c"]["g"]] + [("p", n) for n in r["c"]["p"]])) for r in pages.collect())
    assert got == sorted((image, sorted(nodes)) for (image, _), nodes in want.items())


def test_greedy_in_an_image_equals_the_joins(spark):
    gt, pred = random_lines(spark, 6)
    pages = scoring.by_image(gt, pred)
    counts = scoring.image_counts(pages, [])
    rows = {r["image_id"]: r.asDict() for r in counts.collect()}
    for r in scoring.image_rows(gt, pred, pages.select("image_id")).collect():
        assert {k: v for k, v in rows[r["image_id"]].items() if k != "bow_f1"} == {k: v for k, v in r.asDict().items() if k != "bow_f1"}
        assert rows[r["image_id"]]["bow_f1"] == pytest.approx(r["bow_f1"])
    lines = scoring.line_rows_of(pages).collect()
    assert sorted(map(tuple, lines)) == sorted(map(tuple, scoring.line_rows(gt, pred, scoring.score_units(gt, pred)).collect())) and len(lines) == gt.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize(("name", "most"), [("a01_units", 0), ("a04_line_rows", 0), ("a09_failures_and_exclusions", 0), ("a08_cell_table", 1)])
def test_scorer_writes_few_tables(spark, name, most):
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    tables = lambda: set(glob.glob(f"{folder}/inkgrid-tables/*"))
    before = tables()
    assert plans.QUERIES[name](spark, DATA).count() > 0
    assert len(tables() - before) <= most


def test_token_bags_are_told_in_the_row(spark):
    """Multisets with repeats, nulls and empty sides, and no shuffle of the texts."""
    rows = [(1, ["a", "b2", "b2", "b2"], ["b2", "b2", "c"]), (2, [], ["x"]), (3, None, None), (4, ["7", None, "y"], ["7", "y", "y"]), (5, ["1", "z"], ["1", "z"])]
    df = spark.createDataFrame(rows, "k int, r array<string>, h array<string>")
    bags = scoring.token_bags(df, ["k"], F.col("r"), F.col("h"))
    assert "Exchange" not in bags._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, bags.collect())) == [(1, 2, 4, 3, 3, 2), (2, 0, 0, 1, 0, 0), (3, 0, 0, 0, 0, 0), (4, 2, 2, 3, 1, 1), (5, 2, 2, 2, 1, 1)]


def test_lines_of_ink_equal_the_rows(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice("abc"), (float(rng.randint(0, 30)), float(rng.randint(0, 30)), float(rng.randint(1, 9)), float(rng.randint(4, 20)))) for k in range(25) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, f"k int, i int, ch string, b {G.BOX}")
    ink = F.transform(F.array_sort(F.collect_list(F.struct("i", "ch", "b"))), lambda c: F.struct(c["ch"].alias("ch"), c["b"].alias("b")))
    found = df.groupBy("k").agg(ink.alias("ink")).select("k", F.explode(ordering.lines_of_ink(F.col("ink"))).alias("l")).select("k", "l.*")
    want = ordering.lines_of_characters(df, ["k"], "i")
    assert sorted(map(tuple, found.select("k", "line", "text", "b", "chars", "violations").collect())) == sorted(map(tuple, want.collect()))


def test_runs_in_a_row_equal_the_rows(spark):
    rng = random.Random(4)
    rows = [(k, v) for k in range(30) for v in rng.sample(range(60), rng.randint(1, 25))]
    df = spark.createDataFrame(rows, "k int, v long")
    for bridge in (0, 2):
        found = df.groupBy("k").agg(F.collect_list("v").alias("v")).select("k", F.inline(ordering.runs_in(F.col("v"), bridge)))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ordering.runs(df, ["k"], "v", F.lit(True), bridge).collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize(("name", "most"), [("w03_lines_of_characters", 0), ("w09_ink_runs", 2)])
def test_rows_are_not_shuffled_apart(spark, name, most):
    """Characters and ink columns are never rows on their way."""
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= most


def test_wrapping_is_told_within_an_image(spark, tmp_path):
    """V04 in one pass over the lines, equal to the operators over rows."""
    from inkgrid.plans.standin import gt_lines

    rows = [(k // 5, k % 5 + 1, k * 37 % 101, k * 53 % 19, float(k % 7 + 1), float(k), "R", "O") for k in range(120)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").selectExpr("*", "DATE'1995-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = plans.QUERIES["v04_wrapping"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    gt = gt_lines(spark, str(tmp_path))
    merged = {r[0]: r[1] for r in ordering.merged_lines(gt, ["image_id"]).groupBy("image_id").agg(F.count("*") == F.sum("members")).collect()}
    late = {r[0]: r[1] == 0 for r in ordering.order_violations(gt.select("image_id", "ln", F.col("b.x").alias("x")), ["image_id"], "ln", "x").collect()}
    stack = {r[0]: r[1] for r in ordering.stacked_properly(gt.select("image_id", F.col("ln").alias("line"), "b"), ["image_id"]).collect()}
    got = {r["image_id"]: (r["apart"], r["in_order"], r["stacked"]) for r in found.collect()}
    assert got == {k: (merged[k], late[k], stack[k]) for k in merged} and len({a for a, _, _ in got.values()}) == 2


def test_pairs_of_boxes_are_told_within_an_image(spark, tmp_path):
    rows = [(k // 4 if k < 40 else None, k % 4 + 1, k * 37 % 101, k * 53 % 19, float(k % 7 + 1), float(k), "R", "O") for k in range(44)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").selectExpr("*", "DATE'1995-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = plans.QUERIES["v05_boxes"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    lines = {}
    for image, n, part, supp, quantity, *_ in rows:
        lines.setdefault(image, []).append((part % 40, 30 * n - (24 if part % 3 == 0 else 0), 20 + int(quantity)))
    apart = lambda a, b: max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0) * max(20 - abs(a[1] - b[1]), 0) <= 0.5 * 20 * min(a[2], b[2])
    wanted = {i: i is None or all(apart(a, b) for k, a in enumerate(v) for b in v[:k]) for i, v in lines.items()}
    assert {r["image_id"]: r["disjoint"] for r in found.collect()} == wanted and len(set(wanted.values())) == 2


LINEITEM = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"


def lineitem(spark, folder, rows):
    spark.createDataFrame(rows, LINEITEM).selectExpr("*", "DATE'1995-01-01' AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")


def test_match_components_are_told_within_an_image(spark, tmp_path):
    """equal to the rounds of joins; one shuffle and no written table; nodes of an image of 700 lines stay its own."""
    rows = [(k // 5 if k < 100 else None, k % 5 + 1, k * 37 % 101, k * 53 % 19, float(k % 7 + 1), float(k), "R", "O") for k in range(105)]
    rows += [(77, k + 1, k * 3 % 50, k % 19, float(k % 7 + 1), float(k), "R", "O") for k in range(700)]
    lineitem(spark, tmp_path, rows)
    found = plans.QUERIES["match_components"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    gt, pred = standin.both(spark, str(tmp_path))
    pairs = matching.overlap_join(gt.select("image_id", F.col("ln").alias("g"), F.col("b").alias("a")), pred.select("image_id", "p", "b"), ["image_id"], G.overlap_min(F.col("a"), F.col("b")), 0.5)
    node = lambda c, odd: F.struct("image_id", (F.col(c) * 2 + odd).alias("n"))
    roots = matching.components(pairs.select(node("g", 0).alias("a"), node("p", 1).alias("b"))).groupBy("root").count().collect()
    assert sorted(map(tuple, found.collect())) == sorted((r["root"]["image_id"], r["root"]["n"], r["count"]) for r in roots)
    assert max(r["root"]["n"] for r in roots) > 1000


@pytest.mark.parametrize("name", ["w01_blocks", "j22_pixel_owner", "match_components"])
def test_lines_of_a_large_table_are_spread(spark, tmp_path, monkeypatch, name):
    """a task takes a fixed number of lines, so there are as many tasks as the table asks for; the rows stay the same."""
    lineitem(spark, tmp_path, [(k // 5, k % 5 + 1, k * 37 % 101, k * 53 % 19, float(k % 7 + 1), float(k), "R", "O") for k in range(500)])
    query = plans.QUERIES[name]
    whole = sorted(map(tuple, query(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 25)
    many = query(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, many.collect())) == whole


def test_pixel_owners_are_told_within_an_image(spark, tmp_path):
    """Equal to the joins, for small images, nulls and one of 900 lines; one shuffle and no join, so a task holds its lines, not their pixels."""
    rows = [(k // 5 if k < 100 else None, k % 5 + 1, k * 37 % 101 if k % 9 else None, k * 53 % 19, float(k % 7 + 1), float(k), "R", "O") for k in range(105)]
    rows += [(77, k % 40, k * 3 % 50, k % 19, float(k % 7 + 1), float(k), "R", "O") for k in range(900)]
    lineitem(spark, tmp_path, rows)
    found = plans.QUERIES["j22_pixel_owner"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    gt = standin.gt_lines(spark, str(tmp_path))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct((F.col("b.x") + 4 * k).cast("bigint").alias("x"), (F.col("b.y") + 5 * k).cast("bigint").alias("y"))))
    pixels = gt.select("image_id", at.alias("p")).select("image_id", "p.x", "p.y").distinct()
    want = matching.pixel_owners(pixels, gt.select("image_id", F.col("ln").alias("line"), "b"), ["image_id"], 2)
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 3000
    none = spark.sql("SELECT array(struct(1L AS x, CAST(NULL AS BIGINT) AS y)) AS p, CAST(array() AS array<struct<line:int,b:struct<x:double,y:double,w:double,h:double>>>) AS l")
    assert none.select(matching.pixel_owners_in(F.col("p"), F.col("l"), 2).alias("o")).first()["o"] == []


def test_lines_are_spread_as_the_table_grows(spark, tmp_path, monkeypatch):
    """a larger table means more tasks, not more lines a task."""
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    lineitem(spark, tmp_path, [(k // 4, k % 4 + 1, k, k % 19, 1.0, float(k), "R", "O") for k in range(400)])
    for name in ("j22_pixel_owner", "w01_blocks"):
        assert "hashpartitioning(l_orderkey" in (plan := plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()) and ", 40), REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("kind", ["double", "decimal(15,2)"])
def test_lines_stand_as_in_the_sql(spark, tmp_path, kind):
    """numbers that are not known come last in an image, quantities are rounded; equal to the SQL."""
    duckdb = pytest.importorskip("duckdb")
    some = lambda k, n, v: None if k % n == 0 else v
    rows = [(k // 6, some(k, 7, k % 3), some(k, 5, k * 37 % 101), some(k, 11, k * 53 % 19), some(k, 13, (k % 21) / 2), some(k, 4, float(k)), "R", "O") for k in range(600)]
    spark.createDataFrame(rows, LINEITEM).selectExpr("* EXCEPT (l_quantity)", f"CAST(l_quantity AS {kind}) AS l_quantity", "DATE'1995-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.QUERIES["g11_neighbour_clamp"](spark, str(tmp_path)).select("image_id", "ln", "min_x", "max_x", "min_y", "max_y").collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = duck.execute(f"SELECT image_id, ln, min_x, max_x, min_y, max_y FROM ({plans.ORACLES['g11_neighbour_clamp']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 600


def test_edits_of_short_texts_stay_in_the_jvm(spark):
    """one Python operator for all counts; texts of either way, long, beyond ASCII and null, have the same counts."""
    from inkgrid.functions import text as X

    texts = ["large ring 437 17", " large  ring 437 l7", "", "  ", "a b a b", "b a b", "Stra\u00dfe  \ufb01n 7", "STRASSE fin 8", "word " * 60, "w0rd " * 61 + "x", "\u0661 b 1", None]
    rows = [(a, b) for a in texts for b in texts]
    found = scoring.with_edits(spark.createDataFrame(rows, "ref_n0 string, hyp_n0 string").withColumn("n_gt", F.lit(1)))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in found.collect():
        a, b = r["ref_n0"], r["hyp_n0"]
        p, q = X.normal_form(a), X.normal_form(b)
        assert (r["ref_n1"], r["hyp_n1"]) == (p, q)
        if a is None or b is None:
            assert r["ed_n0"] is r["ed_w"] is None
            continue
        folds = [t.casefold() for t in (p, q)]
        want = [(a, b), (p, q), folds, [t.replace(" ", "") for t in (p, q)], [t.split() for t in (p, q)]]
        assert [r[f"ed_{n}"] for n in ("n0", "n1", "n2", "nows", "w")] == [X.edit_distance(x, y) for x, y in want]
        assert [r[f"len_{n}"] for n in ("n0", "n1", "n2", "nows", "w")] == [len(x) for x, _ in want]


def test_common_tokens(spark):
    from inkgrid.functions import text as X

    rows = [(["a", "b", "b"], ["b", "b", "a", "a"], 3), (["a"], [], 0), (["a", "a"], ["a"], 1), (["a", "b"] * 70, ["b"] * 90, 70), (["a 0", "a", "a"], ["a 0", "a", "a", "a 0"], 3)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>, n int").select("n", X.common_tokens(F.col("a"), F.col("b"))).collect()
    assert all(n == m for n, m in got)


def test_cells_in_one_pass(spark):
    """equal to the cells of the two tables; nothing is written, images without lines and engines without units count."""
    gt, pred = random_lines(spark, 8)
    kind = F.when(F.col("image_id") % 3 == 0, "V06").otherwise("V00")
    pages = scoring.by_image(gt, pred).select("image_id", F.lit("e").alias("engine_id"), kind.alias("variant"), F.lit("dark").alias("theme"), F.lit("m").alias("form_factor"), F.lit(2.0).alias("dpr"), F.lit("ok").alias("status"), "gt", "pred")
    none = F.array().cast(pages.schema["gt"].dataType)
    pages = pages.unionByName(pages.limit(1).select(F.lit(99).alias("image_id"), F.lit("f").alias("engine_id"), *pages.columns[2:6], F.lit("error").alias("status"), none.alias("gt"), none.alias("pred"))).cache()
    keep = pages.columns[1:7]
    want = scoring.cell_table(scoring.unit_rows(pages, keep), scoring.image_counts(pages, keep))
    got = scoring.cells_of(pages, keep)
    shown = lambda df: [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()]
    assert shown(got.select(*want.columns)) == shown(want) and got.count() > 4
    assert {r["n_units"] for r in got.filter("engine_id = 'f'").collect()} == {None}


def test_components_of_long_chains_and_repeats(spark):
    """A chain of 300 lines that overlap, a crowd larger than the lines told at once, and a node twice: one unit each."""
    from inkgrid.operators import told

    chain = [(1, k, f"L{k:03d}", f"g{k}", (0.0, 10.0 * k, 20.0, 12.0)) for k in range(300)]
    crowd = [(2, k, f"L{k:03d}", "g", (float(k), 0.0, 600.0, 9.0)) for k in range(300)]
    twice = [(3, 1, "L001", "a", (0.0, 0.0, 9.0, 9.0)), (3, 1, "L001", "b", (50.0, 0.0, 9.0, 9.0))]
    gt = spark.createDataFrame(chain + crowd + twice, f"image_id int, g int, line_id string, text string, b {G.BOX}")
    pred = spark.createDataFrame([(i, p, "p", (b[0], b[1] + 5.0 * (i == 1), b[2], b[3]), "p", None, False) for i, p, _, _, b in chain + crowd], f"image_id int, p int, text string, b {G.BOX}, normal string, dropped string, icon boolean")
    pages = scoring.by_image(gt, pred)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(told, "PAIRS", 1000)
        rows = [told._told(1, 0.5, (0.5,), False, iter(pages.select("image_id", "gt", "pred").toArrow().to_batches()))]
    units = [(r["image_id"], len(r["gt_ids"]), len(r["pred_ids"])) for b in rows for part in b for r in part.to_pylist()]
    assert sorted(units) == [(1, 300, 300), (2, 300, 300), (3, 2, 0)]


def test_lines_get_their_names_before_they_are_put_together(spark, tmp_path):
    """where parts are too many to be broadcast, lines are shuffled twice, by part and by order, and not thrice; the rows are those of the SQL,
    with unknown numbers of lines and orders too."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(None if k % 17 == 0 else k // 6, None if k % 7 == 0 else k % 3, k * 37 % 101, k * 53 % 19, (k % 21) / 2, float(k), "R", "O") for k in range(300)]
    lineitem(spark, tmp_path, rows)
    spark.createDataFrame([(k, f"big ring {k % 9}") for k in range(90)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    for t in ("lineitem", "part"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plans.QUERIES["a01_units"](spark, str(tmp_path))
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({plans.ORACLES['a01_units']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 300
