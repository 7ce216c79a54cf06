"""Declarative validation: checks are rows (check, status, detail), and a failing one can stop a job.

Seven statuses are in use: PASS, FAIL, N/A, NOT RUN, MEASURED, INVESTIGATE, SEE REPORT.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

STATUSES = ["PASS", "FAIL", "N/A", "NOT RUN", "MEASURED", "INVESTIGATE", "SEE REPORT"]


def status(passed: Column) -> Column:
    """PASS, FAIL, or N/A for null."""
    return F.when(passed, "PASS").when(~passed, "FAIL").otherwise("N/A")


def check(df: DataFrame, name: str, passed: Column, evidence: Column, n: int = 10) -> DataFrame:
    """One row: FAIL if any row fails, with the first ``n`` pieces of evidence in order; N/A for no rows. Only these are gathered."""
    outcome = F.when(F.count("*") == 0, "N/A").when(F.count_if(~passed) > 0, "FAIL").otherwise("PASS")
    counts = df.agg(F.lit(name).alias("check"), outcome.alias("status"), F.count_if(~passed).alias("failures"))
    first = df.filter(~passed).select(evidence.alias("_e")).orderBy("_e").limit(n).agg(F.array_sort(F.collect_list("_e")).alias("evidence"))
    return counts.crossJoin(F.broadcast(first)).select("check", "status", "evidence", "failures")  # one row each


def all_parts(parts: dict[str, Column]) -> Column:
    """struct of the parts and ``passed``, which they all are."""
    return F.struct(*[c.alias(n) for n, c in parts.items()], reduce(lambda a, b: a & b, parts.values()).alias("passed"))


def union(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks).orderBy("check")


def report(checks: DataFrame) -> DataFrame:
    """Markdown table rows in order."""
    return checks.orderBy("check").select(F.format_string("| %s | %s |", "check", "status").alias("line"))


def require_passed(checks: DataFrame) -> DataFrame:
    """The same rows; a FAIL among them raises when they are read."""
    bad = F.raise_error(F.concat(F.lit("check failed: "), F.col("check"))).cast("string")
    return checks.withColumn("status", F.when(F.col("status") == "FAIL", bad).otherwise(F.col("status")))


def completeness(expected: Column, found: Column, boxes: Column, inked: Column, clipped: Column, occluded: Column) -> Column:
    """A document is complete: as many lines as expected, a box and ink for each, nothing clipped or hidden."""
    return all_parts({"lines": expected == found, "boxes": boxes == found, "ink": inked == found, "some": found > 0, "unclipped": clipped == 0, "visible": occluded == 0})


def text_fidelity(inner: Column, tagged: Column, missing: Column, extra: Column) -> Column:
    """Text on the page is the text of the lines, as multisets of tokens."""
    return all_parts({"tokens": inner == tagged, "none_missing": missing == 0, "none_extra": extra == 0, "some": inner > 0})


def cross_scale_text(df: DataFrame, key: list[str], lines: str) -> DataFrame:
    """One text at all scales of a key."""
    return df.groupBy(*key).agg((F.count_distinct(lines) == 1).alias("same"))


def tight_boxes(df: DataFrame, key: list[str]) -> DataFrame:
    """From ink pixels (x, y) and the box struct ``b`` of each: whether all four edge rows and columns hold ink."""
    b = F.col("b")
    edges = [F.col("x") == b["x"], F.col("x") == G.right(b) - 1, F.col("y") == b["y"], F.col("y") == G.bottom(b) - 1]
    return df.groupBy(*key).agg(reduce(lambda p, q: p & q, [F.bool_or(e) for e in edges]).alias("tight"))


def theil_sen(df: DataFrame, key: list[str], x: str, y: str, least: int = 8) -> DataFrame:
    """Median of the slopes of all pairs of a key with different x; null below ``least`` rows or without spread. A key's
    rows are few (images of one size); for many, ``sampled_slopes``."""
    order = Window.partitionBy(*key).orderBy(x, y)
    rows = df.select(*key, F.col(x).alias("_x"), F.col(y).alias("_y"), F.row_number().over(order).alias("_i"))
    other = rows.select(*key, F.col("_x").alias("_u"), F.col("_y").alias("_v"), F.col("_i").alias("_j"))
    pairs = rows.join(other, key).filter("_i < _j AND _x <> _u").groupBy(*key).agg(F.median((F.col("_v") - F.col("_y")) / (F.col("_u") - F.col("_x"))).alias("slope"))
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return sizes.join(pairs, key, "left").select(*key, "n", F.when(F.col("n") >= least, F.col("slope")).alias("slope"))


def coordinate_sanity(df: DataFrame, key: list[str], least_iou: float = 0.5, most_offset: float = 0.25) -> DataFrame:
    """Median IoU of overlapping pairs and median centre offsets in heights, and whether they are sane."""
    off = G.normalised_offset(F.col("a"), F.col("b"))
    rows = df.withColumn("_iou", G.iou(F.col("a"), F.col("b"))).withColumn("_o", off).filter("_iou > 0")
    found = rows.groupBy(*key).agg(F.median("_iou").alias("median_iou"), F.median("_o.dx").alias("median_dx"), F.median("_o.dy").alias("median_dy"))
    sane = (F.col("median_iou") >= least_iou) & (F.abs("median_dx") <= most_offset) & (F.abs("median_dy") <= most_offset)
    return found.withColumn("sane", sane)


def determinism(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, with the run; none if they agree row by row."""
    return first.exceptAll(second).withColumn("only_in", F.lit("first")).unionByName(second.exceptAll(first).withColumn("only_in", F.lit("second")))


def runtime_model(df: DataFrame) -> DataFrame:
    """engine, base and slope of seconds over megapixels (least squares), 90th percentile."""
    return df.groupBy("engine").agg(F.regr_intercept("seconds", "megapixels").alias("base"), F.regr_slope("seconds", "megapixels").alias("per_megapixel"), F.percentile("seconds", F.lit(0.9)).alias("p90"))


def unsteady(df: DataFrame, key: list[str], value: str, most: float = 0.2) -> DataFrame:
    """Coefficient of variation of repeated measurements, and whether it is over ``most``."""
    found = df.groupBy(*key).agg(F.count("*").alias("n"), F.stddev_pop(value).alias("_s"), F.avg(value).alias("_m")).filter("n > 1 AND _m > 0")
    return found.select(*key, (F.col("_s") / F.col("_m")).alias("cv"), (F.col("_s") / F.col("_m") > most).alias("unsteady"))


def baseline_failures(df: DataFrame, known: DataFrame, key: list[str], passed: Column, confidence: Column, low: float = 0.5) -> DataFrame:
    """outcome of each row: pass, known (failed before), flagged (failed, but with low confidence) or new."""
    before = known.select(*key, F.lit(True).alias("_known"))
    outcome = F.when(passed, "pass").when(F.col("_known"), "known").when(confidence < low, "flagged").otherwise("new")
    return df.join(before, key, "left").withColumn("outcome", outcome).drop("_known")


def page_evidence(pages: DataFrame, forbidden: tuple[str, ...] = ("canvas", "iframe", "video", "svg", "img", "script")) -> DataFrame:
    """page_id and counts of tags that a text page must not have, from raw HTML."""
    html = F.lower("html")
    counts = [F.regexp_count(html, F.lit(f"<{t}[\\s>/]")).alias(f"n_{t}") for t in forbidden]
    return pages.select("page_id", *counts).withColumn("clean", reduce(lambda a, b: a & b, [F.col(f"n_{t}") == 0 for t in forbidden]))
