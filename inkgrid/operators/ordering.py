"""Order-dependent operators: blocks, reading order, runs, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def blocks(lines: DataFrame, key: list[str], gap: float = 1.5, shift: float = 8.0, least_height: float = 16.0) -> DataFrame:
    """Adds ``block``: lines (column ``b``) from top to bottom, a new block where the gap to the line before is over
    ``gap`` median heights or the left edge moves by more than ``shift``."""
    b = F.col("b")
    order = Window.partitionBy(*key).orderBy(b["y"], b["x"], b["w"])
    median = F.coalesce(F.median(F.when(b["h"] > 0, b["h"])).over(Window.partitionBy(*key)), F.lit(least_height))
    before = F.lag("b").over(order)
    opens = before.isNull() | (b["y"] - G.bottom(before) > gap * F.col("_median")) | (F.abs(b["x"] - before["x"]) > shift)
    marked = lines.withColumn("_median", median).withColumn("_opens", F.when(opens, 1).otherwise(0))
    running = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("block", running.cast("int")).drop("_median", "_opens")


def block_layout(members: DataFrame, key: list[str]) -> DataFrame:
    """alignment (edge of least population variance; left, centre, right in case of ties; left for one line) and
    line_height (median distance of consecutive tops, null for one line) of each block. Variances are compared after rounding
    to 9 digits: those of edges that are moved alike are equal, but for the last bits, which depend on the order of the sums."""
    b = F.col("b")
    step = (b["y"] - F.lag(b["y"]).over(Window.partitionBy(*key).orderBy(b["y"], b["x"]))).alias("_step")
    spread = lambda edge: F.round(F.var_pop(edge), 9)
    found = members.select(*key, "b", step).groupBy(*key).agg(F.count("*").alias("lines"), spread(b["x"]).alias("_l"), spread(G.centre_x(b)).alias("_c"), spread(G.right(b)).alias("_r"), F.median("_step").alias("line_height"))
    side = F.when((F.col("lines") < 2) | ((F.col("_l") <= F.col("_c")) & (F.col("_l") <= F.col("_r"))), "left").when(F.col("_c") <= F.col("_r"), "center").otherwise("right")
    return found.select(*key, "lines", side.alias("alignment"), "line_height")


def reading_order(items: Column) -> Column:
    """array of struct<b, ..> in reading order. By vertical centre, a box joins the row if its centre is within half
    the smaller height of the row's first box; rows are read from the left. The fold carries the row's first box."""
    keyed = F.transform(items, lambda i: F.struct(G.centre_y(i["b"]).alias("cy"), i["b"]["x"].alias("x"), i.alias("item")))
    ordered = F.array_sort(keyed, lambda p, q: F.when(p["cy"] < q["cy"], -1).when(p["cy"] > q["cy"], 1).when(p["x"] < q["x"], -1).when(p["x"] > q["x"], 1).otherwise(0))

    def placed_in(ordered: Column) -> Column:
        # each item becomes (row, x, place in the order)
        first = F.struct(F.lit(-1).alias("row"), F.lit(0.0).cast("double").alias("cy"), F.lit(0.0).cast("double").alias("h"), F.array().cast("array<int>").alias("rows"))

        def step(s: Column, k: Column) -> Column:
            i = k["item"]["b"]
            joins = (s["row"] >= 0) & (F.abs(k["cy"] - s["cy"]) < 0.5 * F.least(i["h"], s["h"]))
            row = F.when(joins, s["row"]).otherwise(s["row"] + 1)
            return F.struct(row.alias("row"), F.when(joins, s["cy"]).otherwise(k["cy"]).alias("cy"), F.when(joins, s["h"]).otherwise(i["h"]).alias("h"), F.concat(s["rows"], F.array(row)).alias("rows"))

        rows = F.aggregate(ordered, first, step)["rows"]
        placed = F.zip_with(rows, F.transform(ordered, lambda k, n: F.struct(k["x"].alias("x"), n.alias("n"), k["item"].alias("item"))), lambda r, k: F.struct(r.alias("row"), k["x"].alias("x"), k["n"].alias("n"), k["item"].alias("item")))
        final = F.array_sort(placed, lambda p, q: F.when(p["row"] < q["row"], -1).when(p["row"] > q["row"], 1).when(p["x"] < q["x"], -1).when(p["x"] > q["x"], 1).when(p["n"] < q["n"], -1).when(p["n"] > q["n"], 1).otherwise(0))
        return F.transform(final, lambda k: k["item"])

    # a box alone is in order; a variable of a lambda is computed once
    return F.when(F.size(items) < 2, items).otherwise(F.get(F.transform(F.array(ordered), placed_in), 0))


def visual_lines(chars: Column) -> Column:
    """array of struct<text, b> from an ordered array of struct<ch, b>: a new line where the centre leaves the line's
    running box by over half the smaller height; blanks stay with the line before."""
    start = F.array().cast("array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")

    def one(c: Column) -> Column:
        return F.struct(c["ch"].alias("text"), c["b"]["x"].alias("x0"), c["b"]["y"].alias("y0"), G.right(c["b"]).alias("x1"), G.bottom(c["b"]).alias("y1"))

    def step(s: Column, c: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        blank = F.trim(c["ch"]) == ""
        near = F.abs(G.centre_y(c["b"]) - (last["y0"] + last["y1"]) / 2) <= 0.5 * F.least(c["b"]["h"], last["y1"] - last["y0"])
        joined = F.struct(F.concat(last["text"], c["ch"]).alias("text"), *[F.when(blank, last[n]).otherwise(f(last[n], v)).alias(n) for n, f, v in (("x0", F.least, c["b"]["x"]), ("y0", F.least, c["b"]["y"]), ("x1", F.greatest, G.right(c["b"])), ("y1", F.greatest, G.bottom(c["b"])))])
        head = F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
        return F.when((F.size(s) > 0) & (blank | near), F.concat(head, F.array(joined))).otherwise(F.concat(s, F.array(one(c))))

    found = F.aggregate(chars, start, step)
    return F.transform(found, lambda l: F.struct(l["text"].alias("text"), G.box(l["x0"], l["y0"], l["x1"] - l["x0"], l["y1"] - l["y0"]).alias("b")))


def independent_lines(boxes: Column, share: float = 0.5) -> Column:
    """Number of lines left when boxes, from the top, that overlap the running one vertically by over ``share`` of
    the smaller height are merged."""
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y"].alias("y0"), G.bottom(b).alias("y1"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).cast("double").alias("y0"), F.lit(0.0).cast("double").alias("y1"))

    def step(s: Column, b: Column) -> Column:
        common = F.least(s["y1"], b["y1"]) - F.greatest(s["y0"], b["y0"])
        merges = (s["n"] > 0) & (common > share * F.least(s["y1"] - s["y0"], b["y1"] - b["y0"]))
        return F.struct(F.when(merges, s["n"]).otherwise(s["n"] + 1).alias("n"), F.when(merges, s["y0"]).otherwise(b["y0"]).alias("y0"), F.when(merges, F.greatest(s["y1"], b["y1"])).otherwise(b["y1"]).alias("y1"))

    return F.aggregate(ordered, start, step)["n"]


def merged_lines(boxes: DataFrame, key: list[str], share: float = 0.5) -> DataFrame:
    """key, group, y0, y1, members: boxes (column ``b``) from the top, merged while they overlap the running line by over ``share`` of the
    smaller height. The lower edge of the running line is the greatest of all boxes before, as a box that opens a line reaches
    below all of them; only the line's top depends on where it began. Boxes without height take no part."""
    from .scans import first_bound_groups

    b = F.col("b")
    rows = boxes.filter(b["h"] > 0).withColumns({"_y0": b["y"], "_y1": G.bottom(b)})
    order = [F.col("_y0"), F.col("_y1"), b["x"], b["w"]]
    until = F.max("_y1").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    carried = F.struct(F.col("_y0").alias("y0"), F.col("_y1").alias("y1"), until.alias("until"))

    def opens(c: Column, first: Column) -> Column:
        return F.least(c["until"], c["y1"]) - c["y0"] <= share * F.least(c["until"] - first["y0"], c["y1"] - c["y0"])

    grouped = first_bound_groups(rows, key, order, opens, carried)
    return grouped.groupBy(*key, "group").agg(F.min("_y0").alias("y0"), F.max("_y1").alias("y1"), F.count("*").alias("members"))


def merged_in(boxes: Column, share: float = 0.5) -> Column:
    """Number of lines that ``merged_lines`` makes of an array of boxes, by a fold over them."""
    rows = F.array_sort(F.transform(F.filter(boxes, lambda b: b["h"] > 0), lambda b: F.struct(b["y"].alias("y0"), G.bottom(b).alias("y1"), b["x"], b["w"])))
    none = F.lit(None).cast("double")

    def step(s: Column, r: Column) -> Column:
        joins = F.coalesce(F.least(s["y1"], r["y1"]) - F.greatest(s["y0"], r["y0"]) > share * F.least(s["y1"] - s["y0"], r["y1"] - r["y0"]), F.lit(False)) & (s["lines"] > 0)
        return F.struct(F.when(joins, s["lines"]).otherwise(s["lines"] + 1).alias("lines"), F.when(joins, s["y0"]).otherwise(r["y0"]).alias("y0"), F.when(joins, F.greatest(s["y1"], r["y1"])).otherwise(r["y1"]).alias("y1"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("lines"), none.alias("y0"), none.alias("y1")), step)["lines"]


def lines_of_characters(chars: DataFrame, key: list[str], order: str) -> DataFrame:
    """key, line, text, b, chars, violations of characters (``ch``, ``b``) in logical order: a line ends where the centre of a character
    leaves that of the line's first one by over half the smaller height. A blank belongs to the line that was begun last if
    its centre is as near, otherwise to none. Violations are characters left of the one before, or over more than half of it."""
    from .scans import first_bound_groups

    b = F.col("b")
    blank = F.trim("ch") == ""
    place = F.struct(G.centre_y(b).alias("cy"), b["h"].alias("h"))

    def far(c: Column, first: Column) -> Column:
        return F.abs(c["cy"] - first["cy"]) > 0.5 * F.least(c["h"], first["h"])

    ink = first_bound_groups(chars.filter(~blank).select(*key, order, "ch", "b"), key, [F.col(order)], far, place)
    line = Window.partitionBy(*key, "group").orderBy(order)
    before = F.lag("b").over(line)
    late = (b["x"] < before["x"] - 0.5) | (G.right(before) - b["x"] > 0.5 * b["w"])
    marked = ink.withColumn("_late", F.coalesce(late, F.lit(False))).withColumn("_first", F.first(place).over(line))
    # blanks look back to the last character before them
    upto = Window.partitionBy(*key).orderBy(order)
    both = marked.unionByName(chars.filter(blank).select(*key, order, "ch", "b"), allowMissingColumns=True)
    held = both.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("group", "_first")})
    kept = held.filter(F.col("group").isNotNull() & (~blank | ~far(place, F.col("_first"))))
    shown = F.when(~blank, F.col("b"))
    x0, y0 = F.min(shown["x"]), F.min(shown["y"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.when(blank, " ").otherwise(F.col("ch")).alias("ch")))), lambda c: c["ch"]), "")
    lines = kept.groupBy(*key, F.col("group").alias("line")).agg(text.alias("_t"), G.box(x0, y0, F.max(G.right(shown)) - x0, F.max(G.bottom(shown)) - y0).alias("b"), F.count_if(~blank).alias("chars"), F.count_if(F.coalesce("_late", F.lit(False))).alias("violations"))
    return lines.select(*key, "line", F.trim(F.regexp_replace("_t", " +", " ")).alias("text"), "b", "chars", "violations")


def lines_of_ink(ink: Column) -> Column:
    """array of struct<line, text, b, chars, violations>: ``lines_of_characters`` for the characters of one row, an array of struct<ch, b>
    in logical order without blanks. A fold finds where lines begin and carries the first character of the last one; what a line has of
    its own is told from its slice, so the row's characters are never rows of their own."""
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0.0).cast("double").alias("cy"), F.lit(0.0).cast("double").alias("h"))
    places = F.transform(ink, lambda c, i: F.struct(i.alias("i"), G.centre_y(c["b"]).alias("cy"), c["b"]["h"].alias("h")))

    def step(s: Column, c: Column) -> Column:
        opens = (F.size(s["at"]) == 0) | F.coalesce(F.abs(c["cy"] - s["cy"]) > 0.5 * F.least(c["h"], s["h"]), F.lit(False))
        return F.when(opens, F.struct(F.concat(s["at"], F.array(c["i"])).alias("at"), c["cy"].alias("cy"), c["h"].alias("h"))).otherwise(s)

    def late(c: Column, before: Column) -> Column:
        return F.coalesce((c["b"]["x"] < before["b"]["x"] - 0.5) | (G.right(before["b"]) - c["b"]["x"] > 0.5 * c["b"]["w"]), F.lit(False))

    def told(line: Column) -> Column:
        edge = lambda pick, of: pick(F.transform(line["c"], lambda c: of(c["b"])))
        x0, y0 = edge(F.array_min, lambda b: b["x"]), edge(F.array_min, lambda b: b["y"])
        steps = F.zip_with(F.slice(line["c"], 2, F.size(line["c"])), line["c"], lambda c, before: c.isNotNull() & late(c, before))
        return F.struct(
            line["line"].alias("line"), F.array_join(F.transform(line["c"], lambda c: c["ch"]), "").alias("text"), G.box(x0, y0, edge(F.array_max, G.right) - x0, edge(F.array_max, G.bottom) - y0).alias("b"),
            F.size(line["c"]).cast("long").alias("chars"), F.size(F.filter(steps, lambda bad: bad)).cast("long").alias("violations"),
        )

    def cut(at: Column) -> Column:
        return F.transform(F.transform(at, lambda a, n: F.struct(n.alias("line"), F.slice(ink, a + 1, F.coalesce(F.get(at, n + 1), F.size(ink)) - a).alias("c"))), told)

    # a variable of a lambda is computed once
    return F.get(F.transform(F.array(F.aggregate(places, start, step)["at"]), cut), 0)


def order_violations(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Rows of each key whose value is below that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("_before", before).groupBy(*key).agg(F.count_if(F.col(value) < F.col("_before")).alias("violations"))


def is_monotone(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Whether the values of each key never rise along the order; a null value takes no part."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return df.filter(F.col(value).isNotNull()).withColumn("_before", before).groupBy(*key).agg(F.coalesce(F.bool_and(F.col(value) <= F.col("_before")), F.lit(True)).alias("monotone"))


def stacked_properly(df: DataFrame, key: list[str], most: float = 0.5) -> DataFrame:
    """Whether consecutive boxes (column ``b`` by ``line``) go down strictly and overlap by ``most`` of the smaller height at most."""
    after = F.lead("b").over(Window.partitionBy(*key).orderBy("line"))
    b = F.col("b")
    n = F.col("_next")
    fine = (n["y"] > b["y"]) & (G.bottom(b) - n["y"] <= most * F.least(b["h"], n["h"]))
    return df.withColumn("_next", after).groupBy(*key).agg(F.coalesce(F.bool_and(F.when(n.isNotNull(), fine)), F.lit(True)).alias("ordered"))


def runs(df: DataFrame, key: list[str], place: str, flag: Column, bridge: int = 0) -> DataFrame:
    """first, last and run number of runs of flagged places; gaps of up to ``bridge`` places do not end a run."""
    order = Window.partitionBy(*key).orderBy(place)
    kept = df.filter(flag).withColumn("_gap", F.col(place) - F.lag(place).over(order))
    numbered = kept.withColumn("run", F.sum(F.when(F.col("_gap") <= bridge + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "run").agg(F.min(place).alias("first"), F.max(place).alias("last"))


def runs_in(places: Column, bridge: int = 0) -> Column:
    """array of struct<run, first, last>: ``runs`` of the places of one row, an array without repeats in any order."""

    def found(s: Column) -> Column:
        opens = F.filter(F.transform(s, lambda v, i: F.struct(v.alias("v"), (F.coalesce(v - F.get(s, i - 1), F.lit(bridge + 2)) > bridge + 1).alias("new"))), lambda c: c["new"])
        closes = F.filter(F.transform(s, lambda v, i: F.struct(v.alias("v"), (F.coalesce(F.get(s, i + 1) - v, F.lit(bridge + 2)) > bridge + 1).alias("end"))), lambda c: c["end"])
        numbered = F.transform(opens, lambda c, i: F.struct((i + 1).cast("long").alias("run"), c["v"].alias("first")))
        return F.zip_with(numbered, closes, lambda a, b: F.struct(a["run"].alias("run"), a["first"].alias("first"), b["v"].alias("last")))

    return F.get(F.transform(F.array(F.array_sort(places)), found), 0)


def positions(df: DataFrame, key: list[str], order: list[str], advance: Column, spacing: Column | float = 0.0) -> DataFrame:
    """Adds ``position``: sum of advance and spacing of the rows before."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("position", F.coalesce(F.sum(advance + spacing).over(before), F.lit(0.0)))


def circular_neighbours(df: DataFrame, key: list[str], order: list[str], item: str) -> DataFrame:
    """Adds ``following`` and ``previous``, round the ends."""
    w = Window.partitionBy(*key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("following", F.coalesce(F.lead(item).over(w), F.first(item).over(whole))).withColumn("previous", F.coalesce(F.lag(item).over(w), F.last(item).over(whole)))


def last_of(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def holm(tests: DataFrame, family: list[str], p: str, order: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds p_holm and reject: step-down adjustment within each family."""
    w = Window.partitionBy(*family).orderBy(p, *order)
    m, rank = F.count("*").over(Window.partitionBy(*family)), F.row_number().over(w)
    stepped = tests.withColumn("_step", F.least(F.lit(1.0), (m - rank + 1) * F.col(p)))
    adjusted = stepped.withColumn("p_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return adjusted.drop("_step").withColumn("reject", F.col("p_holm") < alpha)


def top_candidates(df: DataFrame, key: list[str], score: str, order: str, n: int = 3) -> DataFrame:
    """The best ``n`` of each key with rank and margin to the next; ties to the earlier in ``order``."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), order)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w)).filter(F.col("rank") <= n)
