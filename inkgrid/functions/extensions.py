"""Rules that the measured design describes in words only; extensions, labelled as such."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def practically_significant(p_holm: Column, delta: Column, base: Column, alpha: float = 0.05) -> Column:
    """Adjusted p below alpha and a difference of at least 0.1 points and 10 % of the base."""
    return (p_holm < alpha) & (F.abs(delta) >= F.greatest(F.lit(0.001), 0.1 * base))


def megapixel_class(width: Column, height: Column) -> Column:
    m = width * height / 1e6
    return F.when(m < 1, "<1").when(m <= 3, "1-3").otherwise(">3")


def flagged_cell(failed: Column, excluded: Column, total: Column, most: float = 0.05) -> Column:
    """More than ``most`` of a cell's images failed or were excluded."""
    return F.coalesce(F.try_divide(failed + excluded, total) > most, F.lit(False))


def rate_at_accuracy(df: DataFrame, key: list[str], rate: str, accuracy: str, target: float) -> DataFrame:
    """Rate at which the accuracy reaches the target, linear in log rate between neighbouring points; null outside."""
    after = Window.partitionBy(*key).orderBy(rate)
    rows = df.withColumn("_r", F.lead(rate).over(after)).withColumn("_a", F.lead(accuracy).over(after))
    spans = (F.least(accuracy, "_a") <= target) & (F.greatest(accuracy, "_a") >= target)
    t = F.try_divide(F.lit(target) - F.col(accuracy), F.col("_a") - F.col(accuracy))
    value = F.exp(F.ln(F.col(rate)) + F.coalesce(t, F.lit(0.0)) * (F.ln(F.col("_r")) - F.ln(F.col(rate))))
    return rows.groupBy(*key).agg(F.min(F.when(spans, value)).alias("rate"))


def small_text_threshold(df: DataFrame, key: list[str], height: str, exact: str, target: float = 0.95) -> DataFrame:
    """x-height at which a logistic fit of exact reading on log2 height reaches the target; null if that is outside
    the heights seen or reading does not improve with height. One Arrow task a key, on counts by height."""
    counts = df.groupBy(*key, height).agg(F.count("*").alias("_n"), F.sum(F.col(exact).cast("double")).alias("_y"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key) + ", x95 double"

    def solve(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, n, y = np.log2(rows[height].to_numpy(float)), rows["_n"].to_numpy(float), rows["_y"].to_numpy(float)
        a, w = np.column_stack((np.ones(len(x)), x)), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (n * p * (1 - p))[:, None]).T @ a + 1e-9 * np.eye(2)
            w = w + np.linalg.solve(h, a.T @ (y - n * p) - 1e-9 * w)
        at = (math.log(target / (1 - target)) - w[0]) / w[1] if w[1] > 0 else math.nan
        return pd.DataFrame([(*names, float(2**at) if x.min() <= at <= x.max() else None)], columns=[*key, "x95"])

    return counts.groupBy(*key).applyInPandas(solve, schema)
