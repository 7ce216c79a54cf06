"""Queries of the validation report: each check on its own rows, then the roll-up of all."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import checks, matching, ordering, pages, scoring
from ..operators.tables import read
from . import flow
from .pages import SEEN, TAGGED
from .registry import query
from .standin import BOXES, GT, OVERLAP, both, gt_lines

_COMPLETE = f"""cov AS (SELECT a.image_id, a.ln, max(CASE WHEN b.ln <> a.ln THEN {OVERLAP} END) AS hidden FROM gt a JOIN gt b USING (image_id) GROUP BY ALL),
complete AS (SELECT g.image_id, count(*) + CASE WHEN g.image_id % 17 = 3 THEN 1 ELSE 0 END AS expected, count(*) AS found, count(*) FILTER (g.w * g.h > 0) AS boxes, count(*) FILTER (g.l_partkey > 0) AS inked, count(*) FILTER (g.x + g.w > 108) AS clipped, count(*) FILTER (coalesce(hidden, 0) > 0.9) AS occluded FROM gt g JOIN cov USING (image_id, ln) GROUP BY g.image_id)"""


def _complete(spark, sf_dir):
    gt = gt_lines(spark, sf_dir)
    a, b = gt.select("image_id", "ln", "l_partkey", F.col("b").alias("a")), gt.select("image_id", F.col("ln").alias("other"), "b")
    over = a.join(b, "image_id").groupBy("image_id", "ln", "l_partkey", "a").agg(F.max(F.when(F.col("ln") != F.col("other"), G.overlap_min(F.col("a"), F.col("b")))).alias("hidden"))
    box, n = F.col("a"), F.count("*")
    found = over.groupBy("image_id").agg(n.alias("found"), F.count_if(G.area(box) > 0).alias("boxes"), F.count_if(F.col("l_partkey") > 0).alias("inked"), F.count_if(G.right(box) > 108).alias("clipped"), F.count_if(F.coalesce("hidden", F.lit(0.0)) > 0.9).alias("occluded"))
    wanted = F.col("found") + F.when(F.col("image_id") % 17 == 3, 1).otherwise(0)
    parts = checks.completeness(wanted, *[F.col(c) for c in ("found", "boxes", "inked", "clipped", "occluded")])
    return found.select("image_id", parts.alias("c")).select("image_id", "c.*")


@query(f"""WITH {GT}, {_COMPLETE} SELECT image_id, expected = found AS lines, boxes = found AS boxes, inked = found AS ink, found > 0 AS some, clipped = 0 AS unclipped, occluded = 0 AS visible,
  expected = found AND boxes = found AND inked = found AND found > 0 AND clipped = 0 AND occluded = 0 AS passed FROM complete""")
def v01_completeness(spark, sf_dir):
    """The six parts of completeness of each image, from boxes."""
    return _complete(spark, sf_dir)


_FIDELITY = f"""{SEEN}, word AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS t, nt > 0 AS inner_ FROM seen WHERE nh = 0 AND text <> ''),
bag AS (SELECT page_id, t, count(*) AS n, count(*) FILTER (inner_) AS m FROM word GROUP BY ALL),
faithful AS (SELECT page_id, sum(n)::BIGINT AS tokens, sum(m)::BIGINT AS tagged_tokens, sum(n - m)::BIGINT AS missing FROM bag GROUP BY page_id)"""


def _faithful(spark, sf_dir):
    nodes = pages.page_nodes(read(spark, sf_dir, "pages"))
    name, token = F.col("name"), F.col("token")
    inside = pages.covered(nodes, {"n_hiding": (name != "#text") & pages.hides(name, token), "n_tagged": name.isin(TAGGED)})
    # a token that occurs n times, m of them within tagged elements, is missing n - m times: over all tokens, those outside
    words = F.size(F.filter(F.split(pages.visible_text(token), r"\s+"), lambda t: t != "")).cast("long")
    shown = inside.filter("name = '#text' AND n_hiding = 0").select("page_id", "n_tagged", words.alias("n")).filter("n > 0")
    found = shown.groupBy("page_id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("n_tagged") > 0, F.col("n")).otherwise(0)).alias("tagged_tokens"))
    return found.withColumn("missing", F.col("tokens") - F.col("tagged_tokens"))


@query(f"""{_FIDELITY} SELECT *, tokens = tagged_tokens AS same, missing = 0 AS none_missing, tokens > 0 AS some, tokens = tagged_tokens AND missing = 0 AND tokens > 0 AS passed FROM faithful""")
def v02_text_fidelity(spark, sf_dir):
    """Tokens that a page shows against those inside tagged elements, as multisets."""
    found = _faithful(spark, sf_dir)
    parts = checks.text_fidelity(F.col("tokens"), F.col("tagged_tokens"), F.col("missing"), F.lit(0))
    return found.withColumn("p", parts).select("page_id", "tokens", "tagged_tokens", "missing", F.col("p.tokens").alias("same"), "p.none_missing", "p.some", "p.passed")


_WRAPPED = """o AS (SELECT image_id, y AS y0, y + h AS y1, row_number() OVER (PARTITION BY image_id ORDER BY y, y + h, x, w) AS k FROM gt),
walk AS (SELECT image_id, k, 1 AS lines, y0, y1 FROM o WHERE k = 1
  UNION ALL SELECT image_id, k, CASE WHEN merges THEN lines ELSE lines + 1 END, CASE WHEN merges THEN ly0 ELSE y0 END, CASE WHEN merges THEN greatest(ly1, y1) ELSE y1 END
  FROM (SELECT o.image_id, o.k, w.lines, o.y0, o.y1, w.y0 AS ly0, w.y1 AS ly1, least(w.y1, o.y1) - greatest(w.y0, o.y0) > 0.5 * least(w.y1 - w.y0, o.y1 - o.y0) AS merges FROM walk w JOIN o ON o.image_id = w.image_id AND o.k = w.k + 1)),
merged AS (SELECT image_id, max(lines) AS merged, count(*) AS n FROM walk GROUP BY image_id),
late AS (SELECT image_id, count(*) FILTER (bad) AS violations FROM (SELECT image_id, x < lag(x) OVER (PARTITION BY image_id ORDER BY ln) AS bad FROM gt) GROUP BY image_id),
stack AS (SELECT image_id, coalesce(bool_and(CASE WHEN ny IS NOT NULL THEN ny > y AND y + 20 - ny <= 10 END), true) AS ordered FROM (SELECT image_id, y, lead(y) OVER (PARTITION BY image_id ORDER BY ln) AS ny FROM gt) GROUP BY image_id),
wrapped AS (SELECT image_id, merged = n AS apart, violations = 0 AS in_order, ordered AS stacked, merged = n AND violations = 0 AND ordered AS passed FROM merged JOIN late USING (image_id) JOIN stack USING (image_id))"""


def _wrapped(spark, sf_dir):
    # all three are told within the row of an image: its lines are grouped where the window that numbers them has put them
    lines = gt_lines(spark, sf_dir).filter("image_id IS NOT NULL").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ln", "b"))).alias("lines"))
    boxes = lines.select("image_id", F.transform("lines", lambda v: v["b"]).alias("b")).withColumn("n", F.size(F.filter("b", lambda b: b["h"] > 0))).filter("n > 0")
    steps = F.zip_with(F.slice("b", F.lit(1), F.size("b") - 1), F.slice("b", F.lit(2), F.size("b")), lambda b, n: F.struct(b.alias("b"), n.alias("n")))
    none = lambda c, bad: F.size(F.filter(c, bad)) == 0
    unstacked = lambda s: ~((s["n"]["y"] > s["b"]["y"]) & (G.bottom(s["b"]) - s["n"]["y"] <= 0.5 * F.least(s["b"]["h"], s["n"]["h"])))
    rows = boxes.withColumn("s", steps).select("image_id", (ordering.merged_in(F.col("b")) == F.col("n")).alias("apart"), none("s", lambda s: s["n"]["x"] < s["b"]["x"]).alias("in_order"), none("s", unstacked).alias("stacked"))
    return rows.withColumn("passed", F.col("apart") & F.col("in_order") & F.col("stacked"))


@query(f"WITH RECURSIVE {GT}, {_WRAPPED} SELECT * FROM wrapped")
def v04_wrapping(spark, sf_dir):
    """Lines of an image stay apart when merged, do not step back, and are stacked."""
    return _wrapped(spark, sf_dir)


_BOXED = f"""pair AS (SELECT a.image_id, max({OVERLAP}) AS worst FROM gt a JOIN gt b ON a.image_id = b.image_id AND a.ln < b.ln GROUP BY a.image_id),
boxed AS (SELECT g.image_id, bool_and(w > 0 AND h > 0) AS positive, bool_and(x >= 0 AND y >= 0 AND x + w <= 120) AS inside, coalesce(any_value(worst), 0) <= 0.5 AS disjoint, bool_and(w > 0 AND h > 0) AND bool_and(x >= 0 AND y >= 0 AND x + w <= 120) AND coalesce(any_value(worst), 0) <= 0.5 AS passed FROM gt g LEFT JOIN pair USING (image_id) GROUP BY g.image_id)"""


def _boxed(spark, sf_dir):
    gt = gt_lines(spark, sf_dir).select("image_id", "ln", "b")
    b = F.col("b")
    parts = gt.groupBy("image_id").agg(F.bool_and((b["w"] > 0) & (b["h"] > 0)).alias("positive"), F.bool_and((b["x"] >= 0) & (b["y"] >= 0) & (G.right(b) <= 120)).alias("inside"), F.collect_list("b").alias("all"))
    # every pair of boxes of an image, within its row
    pairs = F.flatten(F.transform("all", lambda v, k: F.transform(F.slice("all", k + 2, F.size("all")), lambda w: G.overlap_min(w, v))))
    worst = F.when(F.col("image_id").isNotNull(), F.array_max(pairs))  # lines without an image meet no others
    rows = parts.select("image_id", "positive", "inside", (F.coalesce(worst, F.lit(0.0)) <= 0.5).alias("disjoint"))
    return rows.withColumn("passed", F.col("positive") & F.col("inside") & F.col("disjoint"))


@query(f"WITH {GT}, {_BOXED} SELECT * FROM boxed")
def v05_boxes(spark, sf_dir):
    """Boxes have an area, lie on the page, and no two cover half of each other."""
    return _boxed(spark, sf_dir)


_REGISTERED = """off AS (SELECT a.engine, abs(b.x + b.w / 2 - a.x - a.w / 2) AS dx, abs(b.y + b.h / 2 - a.y - a.h / 2) AS dy FROM gt a JOIN pred b ON a.image_id = b.image_id AND a.ln = b.p),
registered AS (SELECT engine, count(*)::BIGINT AS n, median(dx) AS dx, median(dy) AS dy, median(dx) <= 3 AND median(dy) <= 2 AS passed FROM off GROUP BY engine)"""


def _registered(spark, sf_dir):
    gt, pred = both(spark, sf_dir)
    rows = gt.select("image_id", "ln", "engine", F.col("b").alias("a")).join(pred.select("image_id", F.col("p").alias("ln"), "b"), ["image_id", "ln"])
    a, b = F.col("a"), F.col("b")
    found = rows.groupBy("engine").agg(F.count("*").alias("n"), F.median(F.abs(G.centre_x(b) - G.centre_x(a))).alias("dx"), F.median(F.abs(G.centre_y(b) - G.centre_y(a))).alias("dy"))
    return found.withColumn("passed", (F.col("dx") <= 3) & (F.col("dy") <= 2))


@query(f"{BOXES}, {_REGISTERED} SELECT * FROM registered")
def v06_registration(spark, sf_dir):
    """How far the centres of matched boxes lie apart, by engine, against a limit in pixels."""
    return _registered(spark, sf_dir)


_ROLL = " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS n, count(*) FILTER (NOT passed)::BIGINT AS failures, list_sort(list({key}::BIGINT) FILTER (NOT passed))[1:3] AS bad FROM {table_}"
    for name, table_, key in (("A3 completeness", "complete_", "image_id"), ("A5 wrapping", "wrapped", "image_id"), ("B4 boxes", "boxed", "image_id"))
)


@query(f"""WITH RECURSIVE {GT}, {_COMPLETE}, {_WRAPPED}, {_BOXED}, complete_ AS (SELECT image_id, expected = found AND boxes = found AND inked = found AND found > 0 AND clipped = 0 AND occluded = 0 AS passed FROM complete), roll AS ({_ROLL})
SELECT name AS "check", CASE WHEN n = 0 THEN 'N/A' WHEN failures > 0 THEN 'FAIL' ELSE 'PASS' END AS status, failures, array_to_string(coalesce(bad, []), ' ') AS evidence, '| ' || name || ' | ' || CASE WHEN n = 0 THEN 'N/A' WHEN failures > 0 THEN 'FAIL' ELSE 'PASS' END || ' |' AS line FROM roll""")
def v08_report(spark, sf_dir):
    """The checks rolled up, with the first pieces of evidence and the line of the status table."""
    rolled = checks.union([checks.check(rows, name, F.col("passed"), F.col("image_id"), n=3) for name, rows in (("A3 completeness", _complete(spark, sf_dir)), ("A5 wrapping", _wrapped(spark, sf_dir)), ("B4 boxes", _boxed(spark, sf_dir)))])
    lines = checks.report(rolled)
    told = rolled.select("check", "status", "failures", F.array_join(F.col("evidence").cast("array<string>"), " ").alias("evidence"))
    return told.join(lines.withColumn("check", F.regexp_extract("line", r"^\| (.*?) \|", 1)), "check")


@query(f"""{BOXES}, {_REGISTERED} SELECT engine AS "check", CASE WHEN n > 0 THEN 'PASS' END AS status FROM registered""")
def v18_all_passed(spark, sf_dir):
    """Rows of a report that raises when it is read if one of its checks fails; here none does."""
    rows = _registered(spark, sf_dir).select(F.col("engine").alias("check"), checks.status(F.col("n") > 0).alias("status"))
    return checks.require_passed(rows)


@query(f"""WITH cells AS ({flow.CELL_SQL}) SELECT engine_id, dimension, level, M1_cer_n1, M6_line_exact, M8_f1_50, coalesce(M1_cer_n1 = min(M1_cer_n1) OVER c, false) AS best_cer, coalesce(M6_line_exact = max(M6_line_exact) OVER c, false) AS best_exact, coalesce(M8_f1_50 = max(M8_f1_50) OVER c, false) AS best_detection FROM cells WINDOW c AS (PARTITION BY dimension, level)""")
def a30_best_of(spark, sf_dir):
    """Which engine is best in each cell, by error rate, exact lines and detection; ties share."""
    return scoring.best_of(flow.a08_cell_table(spark, sf_dir), ["dimension", "level"], {"best_cer": ("M1_cer_n1", False), "best_exact": ("M6_line_exact", True), "best_detection": ("M8_f1_50", True)}).select("engine_id", "dimension", "level", "M1_cer_n1", "M6_line_exact", "M8_f1_50", "best_cer", "best_exact", "best_detection")
