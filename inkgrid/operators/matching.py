"""Joins of located lines: overlap and IoU joins, components, one-to-one assignment, neighbours, upserts.

Geometric joins always carry an equality key (the image), so they are shuffled joins with the geometry
as residual condition, never products. ``grid`` adds a cell key where one image holds very many boxes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graphs import star_components


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], score: Column, least: float, grid: float | None = None) -> DataFrame:
    """Pairs of ``left`` (column ``a``) and ``right`` (column ``b``) boxes of one key with score >= least > 0.

    With ``grid`` each box is put into every cell of that size it touches and joined by cell; a pair is kept
    in the cell that holds the top left corner of the two boxes' intersection, so it appears once."""
    if grid is None:
        return left.join(right, key).withColumn("score", score).filter(F.col("score") >= least)

    def cells(df: DataFrame, name: str) -> DataFrame:
        b = F.col(name)
        across = F.sequence(F.floor(b["x"] / grid), F.floor(G.right(b) / grid))
        down = F.sequence(F.floor(b["y"] / grid), F.floor(G.bottom(b) / grid))
        return df.withColumn("_cx", F.explode(across)).withColumn("_cy", F.explode(down))

    pairs = cells(left, "a").join(cells(right, "b"), [*key, "_cx", "_cy"])
    own = (F.floor(F.greatest(F.col("a.x"), F.col("b.x")) / grid) == F.col("_cx")) & (F.floor(F.greatest(F.col("a.y"), F.col("b.y")) / grid) == F.col("_cy"))
    return pairs.filter(own).drop("_cx", "_cy").withColumn("score", score).filter(F.col("score") >= least)


def best_partner(left: DataFrame, right: DataFrame, key: list[str], score: Column, by: list[str]) -> DataFrame:
    """``by`` columns of every left row and its best score over the right rows of its key, 0 without any."""
    return left.join(right, key, "left").groupBy(*by).agg(F.coalesce(F.max(score), F.lit(0.0)).alias("best"))


def greedy_assignment(pairs: DataFrame, key: list[str], larger_first: bool = False, crowded: bool = False) -> DataFrame:
    """One-to-one pairs by descending score. ``pairs`` has the key, g, p and score; ties go to the smaller (g, p),
    or to the larger with ``larger_first``. An ordered fold over the pairs of a key, as one image has few boxes: its time grows
    with the square of the pairs of a key. ``crowded`` takes rounds of joins in its place, for keys of thousands of pairs."""
    if crowded:
        if larger_first:
            raise ValueError("the rounds of joins give ties to the smaller pair only")
        return mutual_best_assignment(pairs, key)
    others = [c for c in pairs.columns if c not in key]
    sign = -1 if larger_first else 1
    item = F.struct((-F.col("score")).alias("a"), (F.col("g") * sign).alias("b"), (F.col("p") * sign).alias("c"), F.struct(*others).alias("v"))
    lists = pairs.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    kind = pairs.select(F.struct(*others).alias("v")).schema["v"].dataType.simpleString()
    ids = {c: f"array<{pairs.schema[c].dataType.simpleString()}>" for c in ("g", "p")}
    start = F.struct(F.array().cast(ids["g"]).alias("g"), F.array().cast(ids["p"]).alias("p"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        v = x["v"]
        free = ~F.array_contains(s["g"], v["g"]) & ~F.array_contains(s["p"], v["p"])
        taken = F.struct(F.array_append(s["g"], v["g"]).alias("g"), F.array_append(s["p"], v["p"]).alias("p"), F.array_append(s["kept"], v).alias("kept"))
        return F.when(free, taken).otherwise(s)

    return lists.select(*key, F.inline(F.aggregate("_all", start, step)["kept"])).select(*pairs.columns)


def mutual_best_assignment(pairs: DataFrame, key: list[str], rounds: int = 50) -> DataFrame:
    """The same result by rounds of joins: a pair that is best for both sides is taken and both leave. For keys
    whose pairs do not fit one task. The order is total, so each round takes at least one pair a key."""
    from .tables import written

    taken, left = None, written(pairs)
    g_order = Window.partitionBy(*key, "g").orderBy(F.desc("score"), "g", "p")
    p_order = Window.partitionBy(*key, "p").orderBy(F.desc("score"), "g", "p")
    for _ in range(rounds):
        best = left.withColumn("_g", F.row_number().over(g_order)).withColumn("_p", F.row_number().over(p_order))
        new = written(best.filter("_g = 1 AND _p = 1").drop("_g", "_p"))
        taken = new if taken is None else taken.unionByName(new)
        left = written(left.join(new.select(*key, "g"), [*key, "g"], "left_anti").join(new.select(*key, "p"), [*key, "p"], "left_anti"))
        if left.isEmpty():
            return taken
    raise RuntimeError(f"pairs are left after {rounds} rounds")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (least node reached) from edges ``a, b`` of one orderable type. Nodes without edges are absent."""
    return star_components(edges, rounds)


def components_by_key(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, side, node, component: union-find within each key; nodes are sided ('g' or 'p') as the two kinds number
    alike. ``edges`` has g and p, either null for a node without partner. Components are numbered in the order of
    their least g (those without any last), then least p."""
    schema = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in key) + ", side string, node long, component int"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        names = list(zip(*(rows[c] for c in key), strict=True))
        no_g, no_p = rows["g"].isna(), rows["p"].isna()
        for name, g, p, a, b in zip(names, rows["g"].fillna(0).astype("int64"), rows["p"].fillna(0).astype("int64"), no_g, no_p, strict=True):
            if a and b:
                continue
            low, high = sorted((find((name, "g", g) if not a else (name, "p", p)), find((name, "p", p) if not b else (name, "g", g))))
            parent[high] = low
        number, last = {}, None
        out = []
        for x in sorted(parent):  # a component's root is its least node, so roots come in order
            if x[0] != last:
                number, last = {}, x[0]
            out.append((*x, number.setdefault(find(x), len(number))))
        return pd.DataFrame([(*n, side, node, c) for n, side, node, c in out], columns=[*key, "side", "node", "component"])

    return whole_keys(edges.select(*key, "g", "p"), key, solve, schema)


def whole_keys(df: DataFrame, key: list[str], solve, schema: str) -> DataFrame:
    """``solve`` on frames that hold many keys, each key whole: far fewer Python calls than one a key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in frames:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[key] == rows[key].iloc[-1]).all(axis=1)
            done = rows[~last]
            if len(done):
                yield solve(done)
            held = rows[last]
        if held is not None and len(held):
            yield solve(held)

    return df.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, schema)


def neighbour_clamp(boxes: DataFrame, key: list[str], item: str) -> DataFrame:
    """Bounds a padded crop may not pass: the middle of the gap to the nearest box beside or above and below.
    ``boxes`` has the key, ``item`` and ``b``. Open bounds are 0 and infinity. Every box meets itself, so a row is lost only
    where its key is null: it lies on no image."""
    me, other = boxes.withColumnRenamed("b", "a"), boxes.select(*key, F.col(item).alias("_other"), F.col("b"))
    a, b = F.col("a"), F.col("b")
    beside = (b["y"] < G.bottom(a)) & (G.bottom(b) > a["y"])
    stacked = (b["x"] < G.right(a)) & (G.right(b) > a["x"])
    row, column = beside & ~stacked, stacked & ~beside
    pairs = me.join(other, key)
    infinity = F.lit(float("inf"))
    return pairs.groupBy(*key, item).agg(
        F.greatest(F.lit(0.0), F.max(F.when(row & (G.right(b) <= a["x"]), (G.right(b) + a["x"]) / 2))).alias("min_x"),
        F.least(infinity, F.min(F.when(row & (b["x"] >= G.right(a)), (G.right(a) + b["x"]) / 2))).alias("max_x"),
        F.greatest(F.lit(0.0), F.max(F.when(column & (G.bottom(b) <= a["y"]), (G.bottom(b) + a["y"]) / 2))).alias("min_y"),
        F.least(infinity, F.min(F.when(column & (b["y"] >= G.bottom(a)), (G.bottom(a) + b["y"]) / 2))).alias("max_y"),
    )


def nearest_value(left: DataFrame, right: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each left row with the right row of its key whose ``value`` is nearest to its own; ties to the least
    ``order``. A left row whose key the right side lacks raises at run time."""
    known = right.select(key, F.struct(F.col(value).alias("value"), F.col(order).alias("order")).alias("_r"))
    keys = left.select(key, F.col(value).alias("_want")).distinct()
    best = keys.join(known, key, "left").groupBy(key, "_want").agg(F.min_by("_r", F.struct(F.abs(F.col("_r.value") - F.col("_want")), F.col("_r.order"))).alias("_r"))
    joined = left.join(best, (left[key].eqNullSafe(best[key])) & (left[value].eqNullSafe(best["_want"]))).drop(best[key]).drop("_want")
    checked = F.when(F.col("_r").isNull(), F.raise_error(F.concat(F.lit("unknown key "), F.col(key).cast("string")))).otherwise(F.col("_r"))
    return joined.withColumn("_r", checked).withColumn("nearest", F.col("_r.value")).withColumn("nearest_order", F.col("_r.order")).drop("_r")


def upsert(current: DataFrame, incoming: DataFrame, key: str, kept: list[str] = ()) -> DataFrame:
    """Rows of ``incoming`` replace those of ``current`` with their key, but for the columns ``kept``; new keys are added."""
    old, new = current.alias("c"), incoming.alias("i")
    joined = old.join(new, F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    has_old, has_new = F.col(f"c.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()
    out = []
    for c in current.columns:
        take_old = has_old if c in kept else ~has_new
        out.append(F.when(take_old, F.col(f"c.{c}")).otherwise(F.col(f"i.{c}")).alias(c))
    return joined.select(*out)


def stale(records: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of records whose value is not the current one, or that the current table lacks."""
    now = current.select(key, F.col(value).alias("_now"))
    return records.join(now, key, "left").filter(~F.col(value).eqNullSafe(F.col("_now"))).drop("_now")


def assert_all_known(records: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The inner join; a record whose key is not known raises at run time."""
    marked = records.join(known.withColumn("_known", F.lit(True)), key, "left")
    return marked.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("unknown "), F.col(key).cast("string"))).cast(records.schema[key].dataType))).drop("_known")


def curated_first(items: DataFrame, key: str, chosen: list[str], limit: int) -> DataFrame:
    """The chosen keys in their order, then the others by key, ``limit`` in all."""
    order = F.array_position(F.array(*[F.lit(c) for c in chosen]), F.col(key)) if chosen else F.lit(0)
    return items.withColumn("_o", order).orderBy(F.when(F.col("_o") > 0, F.col("_o")).otherwise(2**31), key).limit(limit).drop("_o")


def multiset_difference(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """item, only_a, only_b: surplus counts of both sides; equal counts are left out."""
    x, y = a.groupBy(item).agg(F.count("*").alias("_x")), b.groupBy(item).agg(F.count("*").alias("_y"))
    d = F.coalesce("_x", F.lit(0)) - F.coalesce("_y", F.lit(0))
    return x.join(y, item, "full_outer").select(item, F.greatest(d, F.lit(0)).alias("only_a"), F.greatest(-d, F.lit(0)).alias("only_b")).filter("only_a > 0 OR only_b > 0")


def touching(regions: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of ``regions`` (column ``a``) and ``lines`` (column ``b``) of one key that share some area, with it."""
    return regions.join(lines, key).withColumn("area", G.intersection(F.col("a"), F.col("b"))).filter("area > 0")


def pixel_owners_in(pixels: Column, lines: Column, pad: int, at_once: int = 64) -> Column:
    """``pixel_owners`` within the row of an image: array of struct<x, y, line> from arrays of struct<x, y> and of struct<line, b>. A
    pixel that no padded box holds is left out. Pixels are taken from the top ``at_once`` by ``at_once``, with the lines at their height only."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731 - a variable of a lambda is computed once

    def bounds(line: Column) -> Column:
        b = line["b"]
        return F.struct(line["line"].alias("line"), F.floor(b["x"]).alias("x0"), F.ceil(G.right(b)).alias("x1"), F.floor(b["y"]).alias("y0"), F.ceil(G.bottom(b)).alias("y1"))

    def held(p: Column, e: Column, by: int) -> Column:
        return (p["y"] >= e["y0"] - by) & (p["y"] < e["y1"] + by) & (p["x"] >= e["x0"] - by) & (p["x"] < e["x1"] + by)

    def owner(p: Column, near: Column) -> Column:
        return F.array_max(F.transform(F.filter(near, lambda e: held(p, e, pad)), lambda e: F.struct(held(p, e, 0).alias("own"), e["line"].alias("line"))))["line"]

    def some(part: Column, edges: Column) -> Column:
        near = F.filter(edges, lambda e: (F.get(part, F.size(part) - 1)["y"] >= e["y0"] - pad) & (F.get(part, 0)["y"] < e["y1"] + pad))
        return once(near, lambda near: F.transform(part, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), owner(p, near).alias("line"))))

    def owned(edges: Column, down: Column) -> Column:
        apart = F.filter(down, lambda p, n: (n == 0) | (F.get(down, n - 1) != p))
        parts = lambda px: F.transform(F.sequence(F.lit(0), F.greatest(F.size(px) - 1, F.lit(0)), F.lit(at_once)), lambda n: F.slice(px, n + 1, at_once))
        found = once(apart, lambda px: F.flatten(F.transform(parts(px), lambda part: some(part, edges))))
        return F.filter(found, lambda o: o["line"].isNotNull())

    whole = F.filter(F.transform(pixels, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return once(F.transform(lines, bounds), lambda edges: once(F.sort_array(whole), lambda down: owned(edges, down)))


def pixel_owners(pixels: DataFrame, lines: DataFrame, key: list[str], pad: int) -> DataFrame:
    """Line that owns each ink pixel (key, x, y): of the lines whose padded box holds it, one whose own box does,
    and of those the last. ``lines`` has the key, ``line`` and ``b``."""
    b = F.col("b")
    near = (F.col("x") >= F.floor(b["x"]) - pad) & (F.col("x") < F.ceil(G.right(b)) + pad) & (F.col("y") >= F.floor(b["y"]) - pad) & (F.col("y") < F.ceil(G.bottom(b)) + pad)
    own = (F.col("x") >= F.floor(b["x"])) & (F.col("x") < F.ceil(G.right(b))) & (F.col("y") >= F.floor(b["y"])) & (F.col("y") < F.ceil(G.bottom(b)))
    held = pixels.join(lines, key).filter(near)
    return held.groupBy(*key, "x", "y").agg(F.max(F.struct(own.alias("own"), F.col("line").alias("line")))["line"].alias("line"))
