"""Ordered scans whose work is spread over ranges of the order, so that one key may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


_MERGES = {"sum": F.sum, "max": F.max, "min": F.min}


def running_states(df: DataFrame, key: list[str], order: list[Column], states: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds, for each of ``states`` (name -> value, and how two are merged: sum, max or min), the merged state of the rows before in
    the key: null for the first row.

    Rows are dealt by ranges of (key, order) and written; each (range, key) is merged by itself, and the states of the
    ranges before, a row a range, are merged in. Rows of one key and equal order stay in one range and take the order of arrival there."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    how = {c: _MERGES[kind] for c, (_, kind) in states.items()}
    values = df.withColumns({f"_state_{c}": v for c, (v, _) in states.items()})
    dealt = values.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order)
    rows = written(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    merged = rows.groupBy("_part", *key).agg(*[how[c](f"_state_{c}").alias(f"_state_{c}") for c in states])
    before = merged.select(F.col("_part").alias("_states_part"), *[F.col(k).alias(f"_states_key{i}") for i, k in enumerate(key)], *[how[c](f"_state_{c}").over(earlier).alias(f"_before_{c}") for c in states])
    same = F.col("_part") == F.col("_states_part")
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"_states_key{i}"))
    here = Window.partitionBy("_part", *key).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(before, same).withColumns({f"_here_{c}": how[c](f"_state_{c}").over(here) for c in states})
    return joined.select(*df.columns, *[merge_two(F.col(f"_here_{c}"), F.col(f"_before_{c}"), kind).alias(c) for c, (_, kind) in states.items()])


def merge_two(a: Column, b: Column, kind: str) -> Column:
    """The merged state; a null one is that of no rows."""
    if kind == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def running_totals(df: DataFrame, key: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Adds, for each of ``totals``, its sum over the rows before in the key: 0 for the first."""
    found = running_states(df, key, order, {c: (v, "sum") for c, v in totals.items()})
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in totals})


def first_bound_groups(df: DataFrame, key: list[str], order: list[Column], opens: Callable[[Column, Column], Column], carried: Column, rounds: int = 100) -> DataFrame:
    """Adds ``group`` (from 0) where a row opens a new group by comparison with the first row of the group so far.

    ``carried`` is the struct of a row that others are compared with; ``opens(carried, first)`` says whether a row opens a group. Each
    round takes the groups of the round before to find every row's first row; rows up to the first wrong one of a key are right after
    it, so the rounds end when none changes: two or three where groups are plain, never more than the rows of a key."""
    place = Window.partitionBy(*key).orderBy(*order)
    rows = written(df.withColumn("_carried", carried).withColumn("_n", F.row_number().over(place)))
    upto = Window.partitionBy(*key).orderBy("_n")
    before = F.lag("_carried").over(upto)
    flags = written(rows.withColumn("_opens", before.isNull() | F.coalesce(opens(F.col("_carried"), before), F.lit(False))))
    group = Window.partitionBy(*key, "_group").orderBy("_n")
    for _ in range(rounds):
        grouped = flags.withColumn("_group", F.sum(F.col("_opens").cast("int")).over(upto))
        # the first row that a row is compared with is that of the group which the row before is in
        first = F.first("_carried").over(group)
        known = grouped.withColumn("_first", first).withColumn("_against", F.lag("_first").over(upto))
        now = known.withColumn("_now", F.col("_against").isNull() | F.coalesce(opens(F.col("_carried"), F.col("_against")), F.lit(False)))
        new = written(now.select(*rows.columns, F.col("_now").alias("_opens"), (F.col("_now") != F.col("_opens")).alias("_changed")))
        if new.filter("_changed").isEmpty():
            return new.select(*df.columns, (F.sum(F.col("_opens").cast("int")).over(upto) - 1).cast("int").alias("group"))
        flags = new.drop("_changed")
    raise RuntimeError(f"groups still change after {rounds} rounds")
