"""Record shaping: names, visibility and style rules, edits, dimension data, ablations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G

# Candidate faces (family, weight, role) in registration order, and image variants (name, format, quality, downscale).
FACES = [
    ("Inter", 400, "sf_pro"), ("Inter", 500, "sf_pro"), ("Inter", 600, "sf_pro"), ("Inter", 700, "sf_pro"),
    ("Roboto", 400, "android"), ("Roboto", 500, "android"), ("Roboto", 700, "android"),
    ("Liberation Sans", 400, "arial"), ("Liberation Sans", 700, "arial"),
    ("TeX Gyre Heros", 400, "helvetica"), ("TeX Gyre Heros", 700, "helvetica"),
    ("Selawik", 400, "segoe_ui"), ("Selawik", 600, "segoe_ui"), ("Selawik", 700, "segoe_ui"),
    ("Noto Sans", 400, "wide_coverage"), ("Noto Sans", 700, "wide_coverage"),
]


def faces(spark: SparkSession) -> DataFrame:
    """The dimension of candidate faces, ``ord`` being the order of registration."""
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FACES)], "ord int, family string, weight int, role string")


def camel(name: str) -> str:
    return re.sub("_+([a-z0-9])", lambda m: m[1].upper(), name)


def snake(name: str) -> str:
    return re.sub("(?<!^)([A-Z])", r"_\1", name).lower()


def renamed(df: DataFrame, rule) -> DataFrame:
    """All columns and nested fields renamed by a rule; structs are cast by position, so nothing is rebuilt by hand."""

    def inside(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(rule(f.name), inside(f.dataType), f.nullable) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(inside(t.elementType), t.containsNull)
        return t

    return df.select(*[F.col(f"`{f.name}`").cast(inside(f.dataType)).alias(rule(f.name)) for f in df.schema.fields])


def within_clips(b: Column, clips: Column, slack: float = 0.5) -> Column:
    """The box lies in every clip rectangle, give or take ``slack``."""
    return F.forall(clips, lambda c: (b["x"] >= c["x"] - slack) & (b["y"] >= c["y"] - slack) & (G.right(b) <= G.right(c) + slack) & (G.bottom(b) <= G.bottom(c) + slack))


def style_allowed(style: Column) -> Column:
    """No style that would part the text from its measured boxes. ``style`` is map<string, string>; a missing entry is the default."""
    value = lambda name, default: F.coalesce(F.try_element_at(style, F.lit(name)), F.lit(default))
    plain = {"text-transform": "none", "transform": "none", "filter": "none", "mix-blend-mode": "normal", "text-shadow": "none", "writing-mode": "horizontal-tb"}
    out = F.lit(True)
    for name, default in plain.items():
        out = out & (value(name, default) == default)
    return out


def same_but(a: Column, b: Column, fields: list[str], ignored: list[str]) -> Column:
    """Two structs agree on all fields but the ignored ones; nulls agree with nulls."""
    kept = [f for f in fields if f not in ignored]
    return F.struct(*[a[f].alias(f) for f in kept]).eqNullSafe(F.struct(*[b[f].alias(f) for f in kept]))


def edited(edits: Column, key: Column, new: Column) -> Column:
    """Map of edits with one key overwritten; a null edit deletes it."""
    rest = F.map_filter(edits, lambda k, _: k != key)
    return F.when(new.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(key, new)))


def style_override(current: Column, incoming: Column, overridden: Column, fields: list[str]) -> Column:
    """Struct of the style fields: those of the user if overridden."""
    return F.struct(*[F.when(overridden, current[f]).otherwise(incoming[f]).alias(f) for f in fields])


def replaced_by_parts(items: Column, is_it, parts: Column) -> Column:
    """Array with the elements for which ``is_it`` holds replaced by the ``parts`` in their place."""
    return F.flatten(F.transform(items, lambda x: F.when(is_it(x), parts).otherwise(F.array(x))))


def ablation(trials: DataFrame, key: list[str], candidate: str, restart: str, score: str) -> DataFrame:
    """key, winner over all restarts, winner of the first restart alone, whether they agree. Ties to the lesser candidate."""
    best = lambda keep: F.max_by(F.when(keep, F.col(candidate)), F.when(keep, F.struct(F.col(score), -F.col(candidate))))
    found = trials.groupBy(*key).agg(best(F.lit(True)).alias("winner"), best(F.col(restart) == 1).alias("first_restart"))
    return found.withColumn("agree", F.col("winner").eqNullSafe(F.col("first_restart")))


def oracle_predictions(truth: DataFrame) -> DataFrame:
    """Predictions that are the truth itself: any scorer must find them perfect."""
    return truth.select("image_id", F.col("g").alias("p"), "text", "b", F.lit(1.0).alias("confidence"))


def cluster_sums(units: DataFrame, cell: list[str], cluster: str, stratum: str, num: str, den: str) -> DataFrame:
    """Numerators and denominators by cluster, as the intervals take them."""
    return units.groupBy(*cell, cluster).agg(F.min(stratum).alias(stratum), F.sum(num).cast("double").alias(num), F.sum(den).cast("double").alias(den))
