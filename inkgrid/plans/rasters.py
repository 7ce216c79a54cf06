"""Queries on tables of pixels: vectors read as images of 8 x 8 pixels with three channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from ..operators.tables import read
from .registry import query

PIXELS = """e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), q AS (SELECT vec_id, i, greatest(least(floor(v * 400 + 128), 255), 0)::INT AS q FROM e),
px AS (SELECT vec_id, (i % 8)::INT AS x, (i // 8)::INT AS y, q AS r, ((q * 3 + i) % 256)::INT AS g, (255 - q)::INT AS b FROM q)"""


def _pixels(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    q = F.greatest(F.least(F.floor(F.col("v") * 400 + 128), F.lit(255)), F.lit(0)).cast("int")
    return e.withColumn("q", q).select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.col("q").alias("r"), ((F.col("q") * 3 + F.col("i")) % 256).alias("g"), (255 - F.col("q")).alias("b"))


@query(f"""WITH {PIXELS}, ring AS (SELECT vec_id, median(r) AS gr, median(g) AS gg, median(b) AS gb FROM px WHERE x < 2 OR y < 2 OR x >= 6 OR y >= 6 GROUP BY vec_id),
far AS (SELECT px.*, gr, gg, gb, abs(r - gr) + abs(g - gg) + abs(b - gb) AS away FROM px JOIN ring USING (vec_id)),
hist AS (SELECT vec_id, floor(least(away, 255))::INT AS level, count(*) AS n FROM far GROUP BY ALL),
cut AS (SELECT vec_id, level, sum(n) OVER u AS w, sum(n * level) OVER u AS s, sum(n) OVER a AS nn, sum(n * level) OVER a AS ss FROM hist WINDOW u AS (PARTITION BY vec_id ORDER BY level), a AS (PARTITION BY vec_id)),
var AS (SELECT vec_id, level, CASE WHEN nn > w THEN w::DOUBLE * (nn - w) * ((s / w - (ss - s) / (nn - w)) * (s / w - (ss - s) / (nn - w))) END AS v FROM cut),
best AS (SELECT vec_id, coalesce((list(level ORDER BY v DESC, level) FILTER (v > 0))[1], 0) AS threshold FROM var GROUP BY vec_id),
parted AS (SELECT *, (away > threshold) <> (avg((away > threshold)::INT) OVER (PARTITION BY vec_id) > 0.5) AS ink FROM far JOIN best USING (vec_id)),
tone AS (SELECT vec_id, median(r) FILTER (ink) AS ir, median(g) FILTER (ink) AS ig, median(b) FILTER (ink) AS ib FROM parted GROUP BY vec_id),
shade AS (SELECT vec_id, threshold, ink, CASE WHEN ir IS NULL THEN 0 ELSE greatest(0, least(1, ((r - gr) * (ir - gr) + (g - gg) * (ig - gg) + (b - gb) * (ib - gb)) / greatest((ir - gr) * (ir - gr) + (ig - gg) * (ig - gg) + (ib - gb) * (ib - gb), 1))) END AS alpha FROM parted JOIN tone USING (vec_id))
SELECT vec_id, any_value(threshold)::INT AS threshold, count(*) FILTER (ink)::BIGINT AS ink_pixels, round(avg(alpha), 9) AS mean_alpha, count(*) FILTER (alpha > 0.95)::BIGINT AS full_pixels FROM shade GROUP BY vec_id""")
def x10_flat_alpha(spark, sf_dir):
    """Ink share of each pixel on a flat ground, by Otsu's threshold from a histogram."""
    shade = P.flat_alpha(_pixels(spark, sf_dir), ["vec_id"])
    return shade.groupBy("vec_id").agg(F.first("threshold").alias("threshold"), F.count_if("text").alias("ink_pixels"), F.round(F.avg("alpha"), 9).alias("mean_alpha"), F.count_if(F.col("alpha") > 0.95).alias("full_pixels"))


_PLANE = ", ".join(f"""(sx{c} * (syy * n - sy * sy) - sxy * (sy{c} * n - sy * s{c}) + sx * (sy{c} * sy - syy * s{c})) / det AS a{c}, (sxx * (sy{c} * n - s{c} * sy) - sx{c} * (sxy * n - sy * sx) + sx * (sxy * s{c} - sy{c} * sx)) / det AS b{c},
  (sxx * (syy * s{c} - sy * sy{c}) - sxy * (sxy * s{c} - sy{c} * sx) + sx{c} * (sxy * sy - syy * sx)) / det AS c{c}""" for c in P.CHANNELS)
_SUMS = ", ".join(f"sum({c})::DOUBLE AS s{c}, sum(x * {c})::DOUBLE AS sx{c}, sum(y * {c})::DOUBLE AS sy{c}" for c in P.CHANNELS)
_ENDS = ", ".join(f"round(least(greatest(a{c} * {e}.px + b{c} * {e}.py + c{c}, 0), 255), 4) AS {name}_{c}" for name, e in (("start", "s"), ("end", "e")) for c in P.CHANNELS)


@query(f"""WITH {PIXELS}, ring AS (SELECT * FROM px WHERE x < 3 OR y < 3 OR x >= 5 OR y >= 5),
sums AS (SELECT vec_id, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x * x)::DOUBLE AS sxx, sum(y * y)::DOUBLE AS syy, sum(x * y)::DOUBLE AS sxy, {_SUMS} FROM ring GROUP BY vec_id),
dets AS (SELECT *, sxx * (syy * n - sy * sy) - sxy * (sxy * n - sy * sx) + sx * (sxy * sy - syy * sx) AS det FROM sums), plane AS (SELECT vec_id, {_PLANE} FROM dets),
tilt AS (SELECT *, (ar + ag + ab) / 3 AS ax, (br + bg + bb) / 3 AS ay FROM plane),
ends AS (SELECT *, list_sort([{{'along': 0.0::DOUBLE, 'i': 0, 'px': 0, 'py': 0}}, {{'along': 7 * ax, 'i': 1, 'px': 7, 'py': 0}}, {{'along': 7 * ay, 'i': 2, 'px': 0, 'py': 7}}, {{'along': 7 * ax + 7 * ay, 'i': 3, 'px': 7, 'py': 7}}]) AS c FROM tilt),
both_ends AS (SELECT *, c[1] AS s, c[4] AS e FROM ends)
SELECT vec_id, round(degrees(atan2(ay, ax)), 6) AS angle, {_ENDS} FROM both_ends""")
def x13_gradient_plane(spark, sf_dir):
    """Plane through the colours of the ring, by the normal equations as sums."""
    planes = P.gradient_plane(_pixels(spark, sf_dir), ["vec_id"])
    return planes.select("vec_id", F.round("angle", 6).alias("angle"), *[F.round(f"{n}_{c}", 4).alias(f"{n}_{c}") for n in ("start", "end") for c in P.CHANNELS])


@query(f"""WITH RECURSIVE {PIXELS}, n AS (SELECT a.vec_id, a.x * 8 + a.y AS u, b.x * 8 + b.y AS v FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND abs(a.r - b.r) <= 40 AND abs(a.g - b.g) <= 90 AND abs(a.b - b.b) <= 40),
seed AS (SELECT vec_id, (vec_id % 8)::INT AS x, (vec_id // 8 % 8)::INT AS y FROM embeddings),
reach AS (SELECT vec_id, x * 8 + y AS u FROM seed UNION SELECT r.vec_id, n.v FROM reach r JOIN n ON n.vec_id = r.vec_id AND n.u = r.u),
f AS (SELECT vec_id, min(u // 8)::INT AS x0, min(u % 8)::INT AS y0, max(u // 8)::INT AS x1, max(u % 8)::INT AS y1, count(*)::BIGINT AS area FROM reach GROUP BY vec_id),
near AS (SELECT vec_id, var_pop(floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)) FILTER (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5) AS variance FROM px GROUP BY vec_id)
SELECT f.*, round(variance, 6) AS variance FROM f JOIN near USING (vec_id)""")
def x14_flood_fill(spark, sf_dir):
    """The region of like colour around a seed, by runs and their components, and how much the grey levels near it vary."""
    px = _pixels(spark, sf_dir)
    scaled = px.withColumn("g", F.col("g") * 4).withColumn("r", F.col("r") * 9).withColumn("b", F.col("b") * 9)  # one tolerance of 360 for all channels
    seeds = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 8).cast("int").alias("x"), (F.floor(F.col("vec_id") / 8) % 8).cast("int").alias("y"))
    filled = P.flood_fill(scaled, ["vec_id"], seeds, 360)
    plain = P.colour_delta(px, ["vec_id"], F.col("x").between(2, 5) & F.col("y").between(2, 5))
    return filled.join(plain.select("vec_id", F.round("variance", 6).alias("variance")), "vec_id")
