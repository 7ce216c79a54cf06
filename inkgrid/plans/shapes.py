"""Queries on records, nesting and extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extensions as E
from ..functions import geometry as G
from ..operators import ordering, records
from ..operators.tables import read
from .registry import query
from .standin import GT, gt_lines


@query("SELECT o_orderkey AS \"orderKey\", o_custkey AS \"custKey\", {'unitPrice': o_totalprice, 'orderDate': o_orderdate}::VARCHAR IS NOT NULL AS has FROM orders")
def p16_wire_names(spark, sf_dir):
    """Snake case to camel case, nested fields too."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"), F.struct(F.col("o_totalprice").alias("unit_price"), F.col("o_orderdate").alias("order_date")).alias("detail"))
    wire = records.renamed(rows, records.camel)
    return wire.select("orderKey", "custKey", F.col("detail.unitPrice").isNotNull().alias("has"))


@query(f"WITH {GT} SELECT image_id, ln, x >= 2 - 0.5 AND y >= -0.5 AND x + w <= 80.5 AND y + h <= 200.5 AND x >= -0.5 AND x + w <= 100.5 AS visible FROM gt")
def p23_clipped(spark, sf_dir):
    clips = F.array(G.box(2, 0, 78, 200), G.box(0, 0, 100, 200))
    return gt_lines(spark, sf_dir).select("image_id", "ln", records.within_clips(F.col("b"), clips).alias("visible"))


@query("SELECT p_partkey, p_size % 3 <> 0 AND p_size % 5 <> 0 AS allowed FROM part")
def p24_style_guard(spark, sf_dir):
    s = F.col("p_size")
    style = F.create_map(F.lit("transform"), F.when(s % 3 == 0, "rotate(1deg)").otherwise("none"), F.lit("filter"), F.when(s % 5 == 0, "blur").otherwise("none"))
    return read(spark, sf_dir, "part").select("p_partkey", records.style_allowed(style).alias("allowed"))


@query("SELECT p_partkey, p_size % 4 <> 0 AS same FROM part")
def p28_same_but_colour(spark, sf_dir):
    a = F.struct(F.col("p_brand").alias("face"), F.col("p_size").alias("size"), F.lit("red").alias("colour"))
    b = F.struct(F.col("p_brand").alias("face"), F.when(F.col("p_size") % 4 == 0, 0).otherwise(F.col("p_size")).alias("size"), F.lit("blue").alias("colour"))
    return read(spark, sf_dir, "part").select("p_partkey", records.same_but(a, b, ["face", "size", "colour"], ["colour"]).alias("same"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a=1;b=' || p_size ELSE 'a=1' END AS edits FROM part")
def n10_edit_maps(spark, sf_dir):
    """N10, S18's bookkeeping: overwrite or delete one key of a map."""
    start = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("0"))
    new = records.edited(start, F.lit("b"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(new)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("edits"))


@query("SELECT p_partkey, CASE WHEN p_size = 4 THEN 'x,4a,4b,y' ELSE 'x,' || p_size || ',y' END AS items FROM part")
def n03_replace_by_parts(spark, sf_dir):
    items = F.array(F.lit("x"), F.col("p_size").cast("string"), F.lit("y"))
    out = records.replaced_by_parts(items, lambda x: x == "4", F.array(F.lit("4a"), F.lit("4b")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(out, ",").alias("items"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'mine' ELSE p_brand END AS face, CASE WHEN p_size % 2 = 0 THEN 1 ELSE p_size END AS size FROM part")
def n11_style_override(spark, sf_dir):
    """N02, N11, P17."""
    mine, auto = F.struct(F.lit("mine").alias("face"), F.lit(1).alias("size")), F.struct(F.col("p_brand").alias("face"), F.col("p_size").alias("size"))
    s = records.style_override(mine, auto, F.col("p_size") % 2 == 0, ["face", "size"])
    return read(spark, sf_dir, "part").select("p_partkey", s["face"].alias("face"), s["size"].alias("size"))


@query("""WITH t AS (SELECT p_brand, p_partkey AS c, p_partkey % 2 + 1 AS r, p_size AS s FROM part), w AS (SELECT p_brand, arg_max(c, (s, -c)) AS winner, arg_max(c, (s, -c)) FILTER (r = 1) AS first_restart FROM t GROUP BY p_brand) SELECT *, winner IS NOT DISTINCT FROM first_restart AS agree FROM w""")
def a42_ablation(spark, sf_dir):
    """A22, A34, A42."""
    t = read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("c"), (F.col("p_partkey") % 2 + 1).alias("r"), F.col("p_size").alias("s"))
    return records.ablation(t, ["p_brand"], "c", "r", "s")


@query("""SELECT o_custkey, min(o_orderpriority) AS stratum, sum(o_orderkey % 7)::DOUBLE AS num, sum(o_orderkey % 11)::DOUBLE AS den FROM orders GROUP BY o_custkey""")
def a12_cluster_sums(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.lit(1).alias("cell"), "o_custkey", F.col("o_orderpriority").alias("stratum"), (F.col("o_orderkey") % 7).alias("num"), (F.col("o_orderkey") % 11).alias("den"))
    return records.cluster_sums(rows, ["cell"], "o_custkey", "stratum", "num", "den").drop("cell")


@query("""SELECT o_orderkey, (o_orderkey % 100) / 1000.0 < 0.05 AND abs((o_orderkey % 13 - 6) / 1000.0) >= greatest(0.001, 0.1 * (o_custkey % 50) / 1000.0) AS significant, CASE WHEN o_custkey * 1000 / 1e6 < 1 THEN '<1' WHEN o_custkey * 1000 / 1e6 <= 3 THEN '1-3' ELSE '>3' END AS mp, coalesce((o_orderkey % 3) / nullif(o_orderkey % 40, 0) > 0.05, false) AS flagged FROM orders""")
def ext_rules(spark, sf_dir):
    """Extensions: practical significance, resolution classes, flagged cells."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    significant = E.practically_significant((k % 100) / 1000.0, (k % 13 - 6) / 1000.0, (c % 50) / 1000.0)
    return read(spark, sf_dir, "orders").select("o_orderkey", significant.alias("significant"), E.megapixel_class(c, F.lit(1000)).alias("mp"), E.flagged_cell(k % 3, F.lit(0), k % 40).alias("flagged"))


@query("""WITH p AS (SELECT n_regionkey, (n_nationkey + 1)::DOUBLE AS r, (n_nationkey * 4)::DOUBLE AS a FROM nation), l AS (SELECT *, lead(r) OVER w AS r2, lead(a) OVER w AS a2 FROM p WINDOW w AS (PARTITION BY n_regionkey ORDER BY r)),
v AS (SELECT n_regionkey, exp(ln(r) + (50 - a) / (a2 - a) * (ln(r2) - ln(r))) AS v FROM l WHERE least(a, a2) <= 50 AND greatest(a, a2) >= 50) SELECT n_regionkey, round(min(v), 6) AS rate FROM (SELECT DISTINCT n_regionkey FROM nation) LEFT JOIN v USING (n_regionkey) GROUP BY n_regionkey""")
def ext_rate_at_accuracy(spark, sf_dir):
    """Extension: rate at an accuracy, on log rate, within the measured range only."""
    p = read(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey") + 1).cast("double").alias("r"), (F.col("n_nationkey") * 4).cast("double").alias("a"))
    return E.rate_at_accuracy(p, ["n_regionkey"], "r", "a", 50.0).select("n_regionkey", F.round("rate", 6).alias("rate"))


@query()
def ext_small_text_threshold(spark, sf_dir):
    """Extension: height at which 95 % of lines read exactly (tested on known curves)."""
    rows = read(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("h"), (F.col("p_size") > F.col("p_partkey") % 30).alias("exact"))
    return E.small_text_threshold(rows, ["p_brand"], "h", "exact")


@query("SELECT l_orderkey AS image_id, l_linenumber::INT AS line, max(l_extendedprice) AS best, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 50")
def o07_first_evidence(spark, sf_dir):
    """The first pieces of evidence in order (a report of 50 by design)."""
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line")).agg(F.max("l_extendedprice").alias("best"), F.count("*").alias("n"))
    return g.filter("n > 1").orderBy("image_id", "line").limit(50)


@query("WITH s AS (SELECT user_id, event_id, value, ts FROM events WHERE event_type = 'error') SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM s) WHERE k <= 2")
def p22_slow_selection(spark, sf_dir):
    """The slowest failures of each user."""
    s = read(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id", "value")
    return ordering.last_of(s, ["user_id"], [F.desc("value"), "event_id"], 2)


_FACES = ", ".join(f"({i}, '{family}', {weight}, '{role}')" for i, (family, weight, role) in enumerate(records.FACES))


@query(f"""WITH face(ord, family, weight, role) AS (VALUES {_FACES}), used AS (SELECT p_partkey, (p_partkey % 23)::INT AS ord, p_size, p_retailprice FROM part)
SELECT family, weight, any_value(role) AS role, count(p_partkey)::BIGINT AS parts, round(avg(p_size), 6) AS mean_size, round(avg(p_retailprice) / 1000, 6) AS ratio FROM face LEFT JOIN used USING (ord) GROUP BY family, weight""")
def r15_faces(spark, sf_dir):
    """The registry of faces as a dimension table, with the measures of the rows that use each."""
    used = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 23).cast("int").alias("ord"), "p_size", "p_retailprice")
    joined = F.broadcast(records.faces(spark)).join(used, "ord", "left")  # 16 faces
    return joined.groupBy("family", "weight").agg(F.first("role").alias("role"), F.count("p_partkey").alias("parts"), F.round(F.avg("p_size"), 6).alias("mean_size"), F.round(F.avg("p_retailprice") / 1000, 6).alias("ratio"))
