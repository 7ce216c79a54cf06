from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from inkgrid.functions import extensions as E
from inkgrid.operators import records as R


def test_wire_names_reach_into_structs(spark):
    df = spark.createDataFrame([(1, (2, [(3,)]))], "region_id int, ui_element struct<fill_color:int,stop_list:array<struct<at_pos:int>>>")
    wire = R.renamed(df, R.camel)
    assert wire.select("regionId", "uiElement.fillColor", F.col("uiElement.stopList")[0]["atPos"]).first()[:] == (1, 2, 3)
    assert R.renamed(wire, R.snake).schema == df.schema


def test_edits_and_overrides(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    row = spark.range(1).select(R.edited(m, F.lit("a"), F.lit("9")).alias("x"), R.edited(m, F.lit("a"), F.lit(None).cast("string")).alias("y"), R.replaced_by_parts(F.array(*map(F.lit, "abc")), lambda v: v == "b", F.array(F.lit("b1"), F.lit("b2"))).alias("z")).first()
    assert (row["x"], row["y"], row["z"]) == ({"a": "9", "b": "2"}, {"b": "2"}, ["a", "b1", "b2", "c"])


def test_style_guard_and_faces(spark):
    style = lambda **k: spark.range(1).select(R.style_allowed(F.create_map(*[F.lit(x) for p in k.items() for x in (p[0].replace("_", "-"), p[1])])).alias("s")).first()["s"]
    assert style(color="red") and style(transform="none") and not style(text_transform="uppercase") and not style(filter="blur(2px)")
    assert R.faces(spark).count() == len(R.FACES) == 16


def test_ablation(spark):
    df = spark.createDataFrame([("r", 1, 1, 0.5), ("r", 2, 2, 0.9), ("q", 1, 1, 0.5), ("q", 2, 1, 0.5)], "k string, c int, restart int, s double")
    got = {r["k"]: (r["winner"], r["first_restart"], r["agree"]) for r in R.ablation(df, ["k"], "c", "restart", "s").collect()}
    assert got == {"r": (2, 1, False), "q": (1, 1, True)}


def test_small_text_threshold_on_a_known_curve(spark):
    rng, rows = random.Random(0), []
    for h in (4, 5, 6, 7, 8, 10, 12, 16, 20):
        p = 1 / (1 + math.exp(-(4 * math.log2(h) - 11)))
        rows += [("known", float(h), rng.random() < p) for _ in range(2000)] + [("flat", float(h), rng.random() < 0.5) for _ in range(50)]
    got = {r["k"]: r["x95"] for r in E.small_text_threshold(spark.createDataFrame(rows, "k string, h double, e boolean"), ["k"], "h", "e").collect()}
    assert got["known"] == pytest.approx(2 ** ((math.log(19) + 11) / 4), rel=0.03) and got["flat"] is None


def test_rate_at_accuracy(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("a", 4.0, 0.9), ("b", 1.0, 0.95), ("b", 2.0, 0.99)], "k string, r double, acc double")
    got = {r["k"]: r["rate"] for r in E.rate_at_accuracy(df, ["k"], "r", "acc", 0.7).collect()}
    assert got["a"] == pytest.approx(2.0) and got["b"] is None
