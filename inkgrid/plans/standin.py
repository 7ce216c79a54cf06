"""Boxes, texts and messages derived from the tables at hand, in integers, so that any engine derives the same.

Ground-truth lines are order lines (one image an order); predictions are the same lines moved and trimmed,
some missing. ``GT`` and ``PRED`` are the same in SQL, for use as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import box
from ..operators.tables import read, spread

GT = """gt AS (SELECT l_orderkey AS image_id, ln, (l_partkey % 40)::DOUBLE AS x, (30 * ln - CASE WHEN l_partkey % 3 = 0 THEN 24 ELSE 0 END)::DOUBLE AS y,
  (20 + l_quantity::BIGINT)::DOUBLE AS w, 20::DOUBLE AS h, l_returnflag AS engine, l_linestatus AS variant, year(l_shipdate)::INT AS theme, l_partkey, l_suppkey
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ln FROM lineitem))"""
PRED = """pred AS (SELECT image_id, ln AS p, x + l_suppkey % 7 AS x, y + l_partkey % 5 AS y, w - l_suppkey % 3 AS w, h, engine, variant, theme FROM gt WHERE l_partkey % 11 <> 0)"""
BOXES = f"WITH {GT}, {PRED}"
#: SQL macros for two boxes with column prefixes a and b.
INTER = "(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0))"
IOU = f"({INTER} / (a.w * a.h + b.w * b.h - {INTER}))"
OVERLAP = f"({INTER} / least(a.w * a.h, b.w * b.h))"


def whole(c: Column, kind: T.DataType) -> Column:
    """A number as ``::BIGINT`` has it in the SQL: the nearest whole one, halves of doubles to the even one, of decimals away from zero."""
    return (F.rint(c) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.round(c)).cast("bigint")


def gt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, ln, b, engine, variant, theme and the part and supplier the box comes from. Lines of an image are in one
    task, of about as many lines however large the table is."""
    order = Window.partitionBy("l_orderkey").orderBy(*[F.col(c).asc_nulls_last() for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    rows = spread(read(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("ln", F.row_number().over(order))
    b = box(F.col("l_partkey") % 40, 30 * F.col("ln") - F.when(F.col("l_partkey") % 3 == 0, 24).otherwise(0), 20 + whole(F.col("l_quantity"), rows.schema["l_quantity"].dataType), F.lit(20))
    return rows.select(F.col("l_orderkey").alias("image_id"), "ln", b.alias("b"), F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("variant"), F.year("l_shipdate").alias("theme"), "l_partkey", "l_suppkey")


def pred_box(g: Column) -> Column:
    """The box of a line of truth as it is predicted."""
    return box(g["x"] + F.col("l_suppkey") % 7, g["y"] + F.col("l_partkey") % 5, g["w"] - F.col("l_suppkey") % 3, g["h"])


def pred_lines(gt: DataFrame) -> DataFrame:
    """image_id, p, b and the dimensions."""
    return gt.filter("l_partkey % 11 <> 0").select("image_id", F.col("ln").alias("p"), pred_box(F.col("b")).alias("b"), "engine", "variant", "theme")


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gt = gt_lines(spark, sf_dir)
    return gt, pred_lines(gt)


TEXTS = """texts AS (SELECT doc_id, lang, source, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents),
pairs AS (SELECT doc_id, lang, source, t AS ref, lead(t) OVER (PARTITION BY lang, source ORDER BY doc_id) AS hyp FROM texts)"""


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ref, hyp: the printable ASCII of a document and of the next one of its language and source."""
    texts = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_replace("text", "[^ -~]", "").alias("ref"))
    return texts.withColumn("hyp", F.lead("ref").over(Window.partitionBy("lang", "source").orderBy("doc_id")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session messages from events: signup detects, view enriches, click edits, purchase styles, others fail or undo."""
    e = read(spark, sf_dir, "events")
    region = F.concat(F.lit("r"), F.pmod("event_id", F.lit(3)).cast("string"))
    kinds = {"signup": "detected", "view": "region", "click": "edit", "purchase": "style"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.when(F.col("event_id") % 2 == 0, "undo").otherwise("error"))
    stub = F.to_json(F.struct(F.array(*[F.struct(F.lit(f"r{i}").alias("id"), F.lit("?").alias("text")) for i in range(3)]).alias("regions")))
    body = F.to_json(F.struct(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), F.lit(400).alias("font_weight"), (F.col("event_id") % 97).alias("font_size")))
    return e.select(F.col("user_id").cast("string").alias("session"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), kind.alias("kind"), region.alias("region"), F.when(kind == "detected", stub).otherwise(body).alias("payload"))
