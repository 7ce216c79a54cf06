"""Queries on measurements, dimensions and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels as K
from ..functions import numeric as N
from ..functions import text as X
from ..operators import checks, generators, matching, ordering, statistics
from ..operators.tables import read
from ..streaming import regions
from .registry import query
from .standin import messages


def _r(c, n=6):
    return F.round(c, n)


@query("SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean, max(value) AS most, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def a23_medians(spark, sf_dir):
    """A15, A21, A23, A36, M08."""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(_r(F.median("value")).alias("med"), _r(F.percentile("value", F.lit(0.9))).alias("p90"), _r(F.avg("value")).alias("mean"), F.max("value").alias("most"), F.count("*").alias("n"))


@query("WITH v AS (SELECT user_id, event_type, count(*) AS n, stddev_pop(value) / avg(value) AS cv, avg(value) AS m FROM events GROUP BY ALL) SELECT user_id, event_type, round(cv, 6) AS cv, cv > 0.2 AS unsteady FROM v WHERE n > 1 AND m > 0")
def a25_variation(spark, sf_dir):
    return checks.unsteady(read(spark, sf_dir, "events"), ["user_id", "event_type"], "value").select("user_id", "event_type", _r(F.col("cv")).alias("cv"), "unsteady")


@query("""SELECT event_id, CASE WHEN v IS NULL OR v >= 0.95 THEN 'none' WHEN v >= 0.85 THEN 'quiet' ELSE 'warning' END AS level, CASE WHEN v IS NULL THEN 'n/a' WHEN v / 10 >= 0.05 THEN 'certain' WHEN v / 10 >= 0.02 THEN 'likely' ELSE 'uncertain' END AS margin,
 round(greatest(0, least(1, (v - 0.3) / (0.9 - 0.3))), 6) AS calibrated, round(least(0.8, greatest(0, least(1, (v - 0.3) / (0.9 - 0.3)))), 6) AS confidence, CASE WHEN v * 6 < 2.2 THEN 1 WHEN v * 6 < 4.2 THEN 2 ELSE 3 END AS scale, round(greatest(-48, least(48, v * 100 - 20)), 6) AS nudged
 FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS v FROM events)""")
def p09_buckets(spark, sf_dir):
    """P09, P10, P11, P12, P14, P18."""
    v = F.col("v")
    rows = read(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 101) / 100.0).alias("v"))
    return rows.select("event_id", N.confidence_level(v).alias("level"), N.margin_level(v / 10).alias("margin"), _r(N.calibrated(v)).alias("calibrated"), _r(N.region_confidence(F.lit(0.8), v)).alias("confidence"), N.scale_bucket(v * 6).alias("scale"), _r(N.nudged(v * 100, F.lit(-20.0))).alias("nudged"))


_LIN = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_LUM = "(0.2126 * " + _LIN.format("r{0}") + " + 0.7152 * " + _LIN.format("g{0}") + " + 0.0722 * " + _LIN.format("b{0}") + ")"


@query(f"""WITH c AS (SELECT p_partkey, (p_partkey % 256) * 0.8 + ((p_partkey * 7) % 256) * (1 - 0.8) AS r1, ((p_partkey * 3) % 256) * 0.8 + ((p_partkey * 11) % 256) * (1 - 0.8) AS g1, ((p_partkey * 5) % 256) * 0.8 + ((p_partkey * 13) % 256) * (1 - 0.8) AS b1,
 (p_partkey * 7) % 256 AS r2, (p_partkey * 11) % 256 AS g2, (p_partkey * 13) % 256 AS b2 FROM part), l AS (SELECT p_partkey, {_LUM.format(1)} AS a, {_LUM.format(2)} AS b FROM c)
SELECT p_partkey, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 3) AS contrast FROM l""")
def m01_contrast(spark, sf_dir):
    k = F.col("p_partkey")
    fg = [k % 256, (k * 3) % 256, (k * 5) % 256]
    bg = [(k * 7) % 256, (k * 11) % 256, (k * 13) % 256]
    return read(spark, sf_dir, "part").select("p_partkey", N.contrast_ratio(fg, F.lit(0.8), bg).alias("contrast"))


@query("""SELECT p_partkey, round(CASE WHEN p_size > 10 THEN 10 * log10(65025.0::DOUBLE / (p_size - 10)) END, 4) AS psnr, round(p_retailprice * 8 / (p_size * 10), 6) AS bpp, round(abs(p_retailprice - p_size) / nullif(p_size - 1, 0), 6) AS delta,
 '#' || lower(printf('%02X%02X%02X', p_partkey % 256, p_size, (p_partkey * 3) % 256)) AS colour, 't_dpr' || CASE p_partkey % 2 WHEN 0 THEN '1' ELSE '1p5' END || '_' || p_brand AS base_id FROM part""")
def m02_scalar_measures(spark, sf_dir):
    """M02, M03, M15, F14, F15."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf_dir, "part").select(
        "p_partkey", N.psnr((s - 10).cast("double")).alias("psnr"), _r(N.bits_per_pixel(F.col("p_retailprice"), s, F.lit(10))).alias("bpp"), _r(F.abs(F.col("p_retailprice") - s) / F.when(s != 1, s - 1)).alias("delta"),
        X.rgb_to_hex(k % 256, s, (k * 3) % 256).alias("colour"), X.base_id(F.lit("t"), F.when(k % 2 == 0, F.lit(1.0)).otherwise(F.lit(1.5)), F.col("p_brand")).alias("base_id"),
    )


@query("""SELECT p_partkey, ('0x' || printf('%02x', p_partkey % 256))::INT AS r, p_size::INT AS g, 255 AS b, [(p_partkey % 256)::DOUBLE, p_size::DOUBLE, 7.0, 1.0] AS css, trim(split_part(p_type, ' ', 1)) AS family FROM part""")
def f15_colours(spark, sf_dir):
    """F15, F17, F18."""
    k, s = F.col("p_partkey"), F.col("p_size")
    rgb = X.hex_to_rgb(X.rgb_to_hex(k % 256, s, F.lit(255)))
    css = F.format_string("rgb(%d, %d, 7)", (k % 256).cast("int"), s)
    names = F.concat(F.lit("\""), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("\", serif"))
    return read(spark, sf_dir, "part").select("p_partkey", rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"), X.css_colour(css).alias("css"), X.first_font_family(names).alias("family"))


@query("""WITH w AS (SELECT p_partkey, p_brand, (p_partkey % 60)::INT AS want FROM part), r AS (SELECT p_brand, p_size, min(p_partkey) AS k FROM part GROUP BY ALL),
j AS (SELECT w.p_partkey, w.want, r.p_size, r.k, row_number() OVER (PARTITION BY w.p_partkey ORDER BY abs(r.p_size - w.want), r.k) AS n FROM w JOIN r USING (p_brand)) SELECT p_partkey, want, p_size AS nearest FROM j WHERE n = 1""")
def j14_nearest_weight(spark, sf_dir):
    """J14, P13's lookup: same family, nearest weight, ties to the first registered."""
    p = read(spark, sf_dir, "part")
    wanted = p.select("p_partkey", "p_brand", (F.col("p_partkey") % 60).cast("int").alias("w"))
    registry = p.groupBy("p_brand", F.col("p_size").alias("w")).agg(F.min("p_partkey").alias("ord"))
    return matching.nearest_value(wanted, registry, "p_brand", "w", "ord").select("p_partkey", F.col("w").alias("want"), "nearest")


@query("""WITH s AS (SELECT p_brand, p_partkey, p_size * 0.01 AS a, (p_retailprice % 100) / 100 AS b FROM part), f AS (SELECT p_brand, p_partkey, unnest(['blend', 'inverse', 'centred']) AS formula, unnest([0.7 * a + 0.3 * b, 1 / (1 + a), (b + 1) / 2]) AS score FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY p_brand, formula ORDER BY round(score, 9) DESC, p_partkey) AS k FROM f) SELECT p_brand, formula, p_partkey AS winner FROM w WHERE k = 1""")
def a33_formula_winners(spark, sf_dir):
    """Winners by each ranking formula, formulas as data."""
    a, b = F.col("p_size") * 0.01, (F.col("p_retailprice") % 100) / 100
    formulas = {"blend": 0.7 * a + 0.3 * b, "inverse": 1 / (1 + a), "centred": (b + 1) / 2}
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.explode(F.array(*[F.struct(F.lit(n).alias("formula"), F.round(c, 9).alias("score")) for n, c in formulas.items()])).alias("f")).select("p_brand", "p_partkey", "f.*")
    best = F.max_by("p_partkey", F.struct("score", -F.col("p_partkey")))
    return rows.groupBy("p_brand", "formula").agg(best.alias("winner"))


@query("""WITH r AS (SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rk, max(p_size) OVER (PARTITION BY p_brand) - p_size AS off FROM part), t AS (SELECT * FROM r WHERE p_partkey % 5 = 0)
SELECT p_brand, round(avg((rk <= 1)::INT), 6) AS top1, round(avg((rk <= 5)::INT), 6) AS top5, round(avg((off <= 10)::INT), 6) AS near FROM t GROUP BY p_brand""")
def a35_hit_rates(spark, sf_dir):
    """How often the true candidate is within the first k, and within a margin of the leader."""
    w = Window.partitionBy("p_brand")
    rows = read(spark, sf_dir, "part").withColumn("rk", F.rank().over(w.orderBy(F.desc("p_size")))).withColumn("off", F.max("p_size").over(w) - F.col("p_size")).filter("p_partkey % 5 = 0")
    return rows.groupBy("p_brand").agg(*[_r(F.avg(c.cast("double"))).alias(n) for n, c in (("top1", F.col("rk") <= 1), ("top5", F.col("rk") <= 5), ("near", F.col("off") <= 10))])


@query("""SELECT p_brand, max(p_retailprice) FILTER (p_size % 7 = 4) AS light, max(p_retailprice) FILTER (p_size % 7 = 6) AS bold FROM part GROUP BY p_brand HAVING light IS NOT NULL AND bold IS NOT NULL""")
def j24_two_candidates(spark, sf_dir):
    """Two candidates of one region side by side; skipped if either is missing."""
    found = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(F.when(F.col("p_size") % 7 == 4, F.col("p_retailprice"))).alias("light"), F.max(F.when(F.col("p_size") % 7 == 6, F.col("p_retailprice"))).alias("bold"))
    return found.filter("light IS NOT NULL AND bold IS NOT NULL")


@query("""WITH t AS (SELECT c_mktsegment AS fam, c_custkey, (abs(c_acctbal) % 1000) / 20000 AS p FROM customer), r AS (SELECT *, least(1, (count(*) OVER (PARTITION BY fam) - row_number() OVER w + 1) * p) AS s, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY fam ORDER BY p, c_custkey)),
h AS (SELECT *, max(s) OVER (PARTITION BY fam ORDER BY k ROWS UNBOUNDED PRECEDING) AS ph FROM r) SELECT fam, c_custkey, round(ph, 6) AS p_holm, ph < 0.05 AS reject FROM h""")
def q10_holm(spark, sf_dir):
    """Q10, W13."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("fam"), "c_custkey", ((F.abs("c_acctbal") % 1000) / 20000).alias("p"))
    return ordering.holm(rows, ["fam"], "p", ["c_custkey"]).select("fam", "c_custkey", _r(F.col("p_holm")).alias("p_holm"), "reject")


_T = "t AS (SELECT c_mktsegment AS stratum, c_nationkey AS cell, c_custkey AS cluster, (c_custkey % 17)::DOUBLE AS ea, (c_custkey % 13)::DOUBLE AS eb, (100 + c_custkey % 41)::DOUBLE AS l FROM customer)"


def _clusters(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("cell"), k.alias("cluster"), (k % 17).cast("double").alias("ea"), (k % 13).cast("double").alias("eb"), (100 + k % 41).cast("double").alias("l"))


@query(f"""WITH {_T}, s AS (SELECT *, sum(l) OVER w AS ll, sum(ea) OVER w / sum(l) OVER w AS ra, sum(eb) OVER w / sum(l) OVER w AS rb FROM t WINDOW w AS (PARTITION BY cell)),
u AS (SELECT cell, stratum, any_value(ra - rb) AS e, count(*) AS n, var_pop((ea - ra * l) / ll - (eb - rb * l) / ll) AS v FROM s GROUP BY ALL)
SELECT cell, round(any_value(e), 8) AS estimate, round(sqrt(sum(CASE WHEN n >= 2 THEN n * n / (n - 1) * v ELSE 0 END)), 8) AS se FROM u GROUP BY cell""")
def q02_paired_difference(spark, sf_dir):
    """Q02, Q03's form."""
    found = statistics.difference_with_error(_clusters(spark, sf_dir), ["cell"], "stratum", ("ea", "l"), ("eb", "l"))
    return found.select("cell", _r(F.col("estimate"), 8).alias("estimate"), _r(F.col("se"), 8).alias("se"))


@query(f"""WITH {_T}, s AS (SELECT *, sum(l) OVER w AS ll, sum(ea) OVER w / sum(l) OVER w AS ra, sum(eb) OVER w / sum(l) OVER w AS rb FROM t WINDOW w AS (PARTITION BY cell)),
u AS (SELECT cell, stratum, any_value(ln(ra) - ln(rb)) AS e, count(*) AS n, var_pop((ea - ra * l) / (ra * ll) - (eb - rb * l) / (rb * ll)) AS v FROM s GROUP BY ALL)
SELECT cell, round(any_value(e), 8) AS estimate, round(sqrt(sum(CASE WHEN n >= 2 THEN n * n / (n - 1) * v ELSE 0 END)), 8) AS se FROM u GROUP BY cell""")
def q03_log_ratio(spark, sf_dir):
    found = statistics.difference_with_error(_clusters(spark, sf_dir), ["cell"], "stratum", ("ea", "l"), ("eb", "l"), log=True)
    return found.select("cell", _r(F.col("estimate"), 8).alias("estimate"), _r(F.col("se"), 8).alias("se"))


@query(f"WITH {_T} SELECT cell, cluster, round((sum(ea) OVER w - ea) / (sum(l) OVER w - l), 8) AS without FROM t WINDOW w AS (PARTITION BY cell)")
def q09_jackknife(spark, sf_dir):
    """Q09, E13."""
    return statistics.leave_one_out(_clusters(spark, sf_dir), ["cell"], "ea", "l").select("cell", "cluster", _r(F.col("without"), 8).alias("without"))


@query("""SELECT c_custkey, round((c_custkey % 50) / 1000.0 * sqrt(2 / 40.0), 8) AS projected, greatest(0.002, 0.25 * (c_custkey % 31) / 100.0) AS threshold, (c_custkey % 50) / 1000.0 * sqrt(2 / 40.0) > greatest(0.002, 0.25 * (c_custkey % 31) / 100.0) AS increase FROM customer""")
def q13_sample_size(spark, sf_dir):
    """Q13, M09, V15."""
    k = F.col("c_custkey")
    s = statistics.sample_size((k % 50) / 1000.0, (k % 31) / 100.0, 2, 40)
    return read(spark, sf_dir, "customer").select("c_custkey", _r(s["projected"], 8).alias("projected"), s["threshold"].alias("threshold"), s["increase"].alias("increase"))


@query()
def q04_ratio_intervals(spark, sf_dir):
    """Bootstrap-t intervals by cell (tested on coverage and hand cases)."""
    return statistics.intervals(_clusters(spark, sf_dir), ["cell"], "cluster", "stratum", ["ea", "l"], "boot_t", b=999)


@query()
def q05_difference_intervals(spark, sf_dir):
    """Q05, Q06."""
    return statistics.intervals(_clusters(spark, sf_dir), ["cell"], "cluster", "stratum", ["ea", "l", "eb", "l"], "boot_t_sym", b=999)


@query()
def q07_rate_ratio_intervals(spark, sf_dir):
    return statistics.intervals(_clusters(spark, sf_dir), ["cell"], "cluster", "stratum", ["ea", "l", "eb", "l"], "log_boot_t", b=999)


@query("""WITH r AS (SELECT r_name AS method, r_regionkey AS k FROM region), c AS (SELECT method, s, t, (0.935 + 0.004 * k + 0.003 * s + CASE t WHEN 'diff' THEN 0.002 ELSE 0 END)::DOUBLE AS coverage FROM r, (SELECT unnest([0, 1, 2]) AS s), (SELECT unnest(['ratio', 'diff']) AS t)),
v AS (SELECT method, max(abs(coverage - 0.95)) AS gap, min(coverage) >= 0.93 AND max(coverage) <= 0.97 AS passes FROM c GROUP BY method), k AS (SELECT *, row_number() OVER (ORDER BY passes DESC, round(gap, 9), method) AS k FROM v) SELECT method, round(gap, 6) AS worst_gap, passes, passes AND k = 1 AS chosen FROM k""")
def q12_choose_method(spark, sf_dir):
    """Q12, A38."""
    r = read(spark, sf_dir, "region").select(F.col("r_name").alias("method"), F.col("r_regionkey").alias("k"))
    s = spark.range(3).withColumnRenamed("id", "scenario")
    t = spark.createDataFrame([("ratio",), ("diff",)], "target string")
    value = 0.935 + 0.004 * F.col("k") + 0.003 * F.col("scenario") + F.when(F.col("target") == "diff", 0.002).otherwise(0.0)
    found = statistics.choose_method(generators.grid(r, s, t).select("method", "scenario", "target", F.round(value, 9).alias("coverage")))
    return found.select("method", _r(F.col("worst_gap")).alias("worst_gap"), "passes", "chosen")


@query("SELECT a.r_name AS template, b.n_name AS theme, v AS variant FROM region a, nation b, (SELECT unnest(['V00', 'V05']) AS v)")
def e10_grid(spark, sf_dir):
    """E10, E11, E12."""
    v = spark.createDataFrame([("V00",), ("V05",)], "variant string")
    return generators.grid(read(spark, sf_dir, "region").select(F.col("r_name").alias("template")), read(spark, sf_dir, "nation").select(F.col("n_name").alias("theme")), v)


@query("SELECT r_name, list_slice(s, list_position(s, f), 9) AS left_stages FROM (SELECT r_name, ['fonts', 'render', 'variants', 'ocr', 'score', 'validate'] AS s, ['fonts', 'render', 'variants', 'ocr', 'score', 'validate'][r_regionkey + 1] AS f FROM region)")
def e16_stages_from(spark, sf_dir):
    s = F.array(*[F.lit(x) for x in ("fonts", "render", "variants", "ocr", "score", "validate")])
    return read(spark, sf_dir, "region").select("r_name", generators.stages_from(s, F.get(s, F.col("r_regionkey"))).alias("left_stages"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'ok' WHEN c_custkey % 4 = 1 THEN 'resource_oom' WHEN c_custkey % 4 = 2 THEN 'timeout' ELSE 'error' END AS outcome FROM customer""")
def s16_attempt_outcome(spark, sf_dir):
    k = F.col("c_custkey") % 4
    a = lambda s, oom: F.struct(s.alias("status"), oom.alias("oom_killed"))
    attempts = F.array(a(F.when(k == 2, "timeout").otherwise("error"), k == 1), a(F.when(k == 0, "ok").otherwise("error"), k.isin(1, 3) & (k == 1)))
    return read(spark, sf_dir, "customer").select("c_custkey", regions.attempt_outcome(attempts).alias("outcome"))


@query("""WITH s AS (SELECT r_regionkey AS step, 100 * (r_regionkey + 1) AS ms FROM region), e AS (SELECT step, sum(ms) OVER (ORDER BY step) AS hi, sum(ms) OVER (ORDER BY step) - ms AS lo, sum(ms) OVER () AS loop FROM s)
SELECT event_id, step FROM events JOIN e ON (event_id * 37) % loop >= lo AND (event_id * 37) % loop < hi""")
def s17_timeline(spark, sf_dir):
    """S17, M10."""
    steps = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("step"), (100 * (F.col("r_regionkey") + 1)).alias("ms"))
    return regions.step_at(steps, read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37).alias("at"))).select("event_id", "step")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)
SELECT user_id, arg_max(event_id, ts) AS event_id, count(*)::BIGINT AS burst FROM b GROUP BY user_id, b.burst""")
def s12_debounce(spark, sf_dir):
    """The last event of each burst."""
    return regions.debounced(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "1 hour").select("user_id", "event_id", "burst")


@query()
def s03_session_state(spark, sf_dir):
    """Final state of all sessions (tested against orders of arrival)."""
    return regions.replay(messages(spark, sf_dir))


@query("""WITH e AS (SELECT *, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings), a AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL) SELECT label, round(sqrt(sum(m * m)), 5) AS norm, round(max(abs(m)), 5) AS most FROM a GROUP BY label""")
def x24_profiles(spark, sf_dir):
    """Profiles as exploded arrays, aggregated by place."""
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    a = e.groupBy("label", "i").agg(F.avg("v").alias("m"))
    return a.groupBy("label").agg(_r(F.sqrt(F.sum(F.col("m") * F.col("m"))), 5).alias("norm"), _r(F.max(F.abs("m")), 5).alias("most"))


@query("""WITH p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings), m AS (SELECT vec_id, list_transform(range(1, 65), lambda i: (a[i] > 0)::INT) AS x, list_transform(range(1, 65), lambda i: (b[i] > 0)::INT) AS y FROM p WHERE b IS NOT NULL),
c AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: least(x[i], y[i]))) AS n, list_sum(list_transform(range(1, 65), lambda i: greatest(x[i], y[i]))) AS u FROM m) SELECT vec_id, round(CASE WHEN u = 0 THEN 1 ELSE n / u END, 6) AS iou FROM c""")
def x01_mask_iou(spark, sf_dir):
    """IoU of sign masks of neighbouring vectors, by the Arrow kernel."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("float")).alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", _r(K.mask_iou_column("a", "b", F.lit(8), F.lit(8))).alias("iou"))


@query()
def x02_similarity(spark, sf_dir):
    """SSIM and blended score of neighbouring vectors as 8 x 8 images (tested against the window sums)."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", K.ssim_column("a", "b", F.lit(8), F.lit(8)).alias("ssim"), K.blended_score_column("a", "b", F.lit(8), F.lit(8)).alias("score"))


@query("""SELECT label, round(var_pop(v), 6) AS variance, round(median(v), 6) AS med, count(*)::BIGINT AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) WHERE i < 8 OR i >= 56 OR i % 8 = 0 OR i % 8 = 7 GROUP BY label""")
def x09_ring_statistics(spark, sf_dir):
    """Population variance and median over a border ring."""
    i = F.col("i")
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    ring = (i < 8) | (i >= 56) | (i % 8 == 0) | (i % 8 == 7)
    return e.filter(ring).groupBy("label").agg(_r(F.var_pop("v")).alias("variance"), _r(F.median("v")).alias("med"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), p AS (SELECT a.vec_id, a.i, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)
SELECT vec_id, count(*) FILTER (x > 0 AND y <= 0 OR x <= 0 AND y > 0)::BIGINT AS differing, round(avg(abs(x - y)), 6) AS mean_delta, min(i % 8) FILTER ((x > 0) <> (y > 0)) AS x0, max(i // 8) FILTER ((x > 0) <> (y > 0)) AS y1 FROM p GROUP BY vec_id""")
def x21_pixel_difference(spark, sf_dir):
    """Differing pixels, their bounds, mean absolute difference, relationally."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("x").alias("y")), ["vec_id", "i"])
    d = (F.col("x") > 0) != (F.col("y") > 0)
    return pairs.groupBy("vec_id").agg(F.count_if(d).alias("differing"), _r(F.avg(F.abs(F.col("x") - F.col("y")))).alias("mean_delta"), F.min(F.when(d, (F.col("i") % 8).cast("bigint"))).alias("x0"), F.max(F.when(d, F.floor(F.col("i") / 8))).alias("y1"))


@query("""WITH s AS (SELECT p_partkey, (p_partkey % 101) / 100.0 AS t FROM part) SELECT p_partkey, floor(CASE WHEN t <= 0.25 THEN 200 WHEN t >= 0.75 THEN 20 ELSE 200 + (20 - 200) * (t - 0.25) / (0.75 - 0.25) END + 0.5)::INT AS r FROM s""")
def g19_gradient(spark, sf_dir):
    """Sorted stops, linear between, rounded half up."""
    stop = lambda p, r: F.struct(F.lit(p).alias("position"), F.lit(r).alias("r"))
    t = (F.col("p_partkey") % 101) / 100.0
    return read(spark, sf_dir, "part").select("p_partkey", G.gradient_at(F.array(stop(0.75, 20), stop(0.25, 200)), t, "r").alias("r"))


@query("""WITH e AS (SELECT event_type, value >= 20 AS ok FROM events) SELECT event_type AS "check", CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) FILTER (NOT ok)::BIGINT AS failures FROM e GROUP BY event_type""")
def v08_checks(spark, sf_dir):
    """V01 to V14's form, P29, A30, O07, K11: checks as rows."""
    e = read(spark, sf_dir, "events")
    names = ["click", "error", "purchase", "signup", "view"]
    rows = [checks.check(e.filter(F.col("event_type") == n), n, F.col("value") >= 20, F.col("event_id")) for n in names]
    return checks.union(rows).filter("status <> 'N/A'").select("check", "status", "failures")


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS k, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 3 = 0) SELECT k, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (k)""")
def j18_upsert(spark, sf_dir):
    """What arrives replaces rows of its key; new keys are added."""
    o = read(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v"))
    return matching.upsert(old, new, "k")


@query("""WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0) SELECT o.o_orderkey, CASE WHEN o_totalprice >= 50000 THEN 'pass' WHEN k.o_orderkey IS NOT NULL THEN 'known' WHEN (o.o_orderkey % 100) / 100.0 < 0.5 THEN 'flagged' ELSE 'new' END AS outcome FROM orders o LEFT JOIN k USING (o_orderkey)""")
def a44_failures_vs_baseline(spark, sf_dir):
    """A41, A44."""
    o = read(spark, sf_dir, "orders")
    found = checks.baseline_failures(o, o.filter("o_orderkey % 7 = 0").select("o_orderkey"), ["o_orderkey"], F.col("o_totalprice") >= 50000, (F.col("o_orderkey") % 100) / 100.0)
    return found.select("o_orderkey", "outcome")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, round(o_totalprice / 1000) AS p FROM orders) SELECT o_custkey, count(*)::BIGINT AS searches, count(DISTINCT p)::BIGINT AS renders, (count(*) - count(DISTINCT p))::BIGINT AS hits FROM s GROUP BY o_custkey""")
def a43_work_counters(spark, sf_dir):
    """Hits of a memo are repeats within a search."""
    s = read(spark, sf_dir, "orders").select("o_custkey", F.round(F.col("o_totalprice") / 1000).alias("p"))
    return s.groupBy("o_custkey").agg(F.count("*").alias("searches"), F.count_distinct("p").alias("renders")).withColumn("hits", F.col("searches") - F.col("renders"))


@query("""SELECT o_orderpriority AS variant, sum(length(o_orderpriority) + o_custkey % 10)::BIGINT AS bytes, (sum(length(o_orderpriority) + o_custkey % 10) * 10)::BIGINT AS projected FROM orders GROUP BY 1""")
def a26_bytes(spark, sf_dir):
    """A26, V14, R09."""
    n = F.sum(F.length("o_orderpriority") + F.col("o_custkey") % 10)
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("variant")).agg(n.alias("bytes"), (n * 10).alias("projected"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey = o_orderkey % 1000 END AS hash_ok, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status FROM orders WHERE o_orderstatus <> 'X'""")
def p27_records(spark, sf_dir):
    """Flags that are null unless the run was fine; defaulting."""
    ok = F.col("o_orderstatus") == "F"
    return read(spark, sf_dir, "orders").filter("o_orderstatus <> 'X'").select("o_orderkey", F.when(ok, F.col("o_custkey") == F.col("o_orderkey") % 1000).alias("hash_ok"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("none")).alias("status"))


@query("""SELECT o_orderkey, n_name, round(o_totalprice, 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def j01_lookup_joins(spark, sf_dir):
    """Equality lookups; the optimizer broadcasts what its statistics prove small."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("o_orderkey", "n_name", _r(F.col("o_totalprice"), 2).alias("price"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def n06_json_field(spark, sf_dir):
    """A field of JSON text."""
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k IS NOT NULL")
