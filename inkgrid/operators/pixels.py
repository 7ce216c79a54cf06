"""Images as tables of pixels: key columns, x, y and channels r, g, b (0 to 255). No image is ever one value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import star_components

CHANNELS = ("r", "g", "b")


def sized(pixels: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``w`` and ``h``, the extent of the image from 0."""
    size = pixels.groupBy(*key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return pixels.join(size, key)


def in_ring(width: Column) -> Column:
    """Whether a pixel lies within ``width`` of the border."""
    return (F.col("x") < width) | (F.col("y") < width) | (F.col("x") >= F.col("w") - width) | (F.col("y") >= F.col("h") - width)


def otsu_threshold(levels: DataFrame, key: list[str], level: str) -> DataFrame:
    """key, threshold: the 8-bit level with the greatest variance between the two classes (the least such level; 0 if there is
    one level only). A histogram, cumulative sums over it, and an argmax."""
    bins = levels.groupBy(*key, level).agg(F.count("*").alias("_n"))
    upto, whole = Window.partitionBy(*key).orderBy(level), Window.partitionBy(*key)
    mass = F.col("_n") * F.col(level)
    cut = bins.select(*key, level, F.sum("_n").over(upto).alias("_below"), F.sum(mass).over(upto).alias("_low"), F.sum("_n").over(whole).alias("_all"), F.sum(mass).over(whole).alias("_sum"))
    above = F.col("_all") - F.col("_below")
    gap = F.col("_low") / F.col("_below") - (F.col("_sum") - F.col("_low")) / above
    between = F.when(above > 0, F.col("_below").cast("double") * above * (gap * gap))
    best = F.max_by(level, F.struct(between.alias("v"), (-F.col(level)).alias("l")))
    return cut.groupBy(*key).agg(F.when(F.max(between) > 0, best).otherwise(0).cast("int").alias("threshold"))


def flat_alpha(pixels: DataFrame, key: list[str], ring: int = 2) -> DataFrame:
    """Adds ``threshold``, ``text`` (whether a pixel is in the ink class) and ``alpha``, its share of ink on a flat ground.

    The ground is the median of the ring; distances from it are parted by Otsu's threshold, the smaller class is ink, and
    pixels are projected on the line from the ground to the median ink. Without ink alpha is 0."""
    rows = sized(pixels, key)
    ground = rows.filter(in_ring(F.lit(ring))).groupBy(*key).agg(*[F.median(c).alias(f"_g{c}") for c in CHANNELS])
    away = reduce(lambda a, b: a + b, [F.abs(F.col(c) - F.col(f"_g{c}")) for c in CHANNELS])
    far = rows.join(ground, key).withColumn("_away", away)
    cut = otsu_threshold(far.withColumn("_level", F.floor(F.least(F.col("_away"), F.lit(255.0))).cast("int")), key, "_level")
    marked = far.join(cut, key).withColumn("_far", F.col("_away") > F.col("threshold"))
    most = marked.groupBy(*key).agg((F.avg(F.col("_far").cast("int")) > 0.5).alias("_flip"))
    parted = marked.join(most, key).withColumn("text", F.col("_far") != F.col("_flip"))
    ink = parted.groupBy(*key).agg(*[F.median(F.when(F.col("text"), F.col(c))).alias(f"_i{c}") for c in CHANNELS])
    placed = parted.join(ink, key)
    along = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"_g{c}")) * (F.col(f"_i{c}") - F.col(f"_g{c}")) for c in CHANNELS])
    length = reduce(lambda a, b: a + b, [(F.col(f"_i{c}") - F.col(f"_g{c}")) * (F.col(f"_i{c}") - F.col(f"_g{c}")) for c in CHANNELS])
    alpha = F.when(F.col("_ir").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / F.greatest(length, F.lit(1.0)))))
    return placed.select(*pixels.columns, "threshold", "text", alpha.alias("alpha"))


def gradient_plane(pixels: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """key, angle, start_c and end_c of each channel: a plane through the colours of the ring, at its extreme corners.

    The ring is up to ``most`` pixels wide and at most half the image. The normal equations are sums, solved in closed form; null where
    they have no single solution (an image of one row or column, or fewer than three pixels)."""
    rows = sized(pixels, key)
    width = F.greatest(F.least(F.lit(most), F.floor(F.col("h") / 2), F.floor(F.col("w") / 2)), F.lit(1))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sums = [F.count("*").cast("double").alias("n"), *[F.sum(v).alias(n) for n, v in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))]]
    sums += [F.sum(v * F.col(c)).alias(f"{n}{c}") for c in CHANNELS for n, v in (("s", F.lit(1.0)), ("sx", x), ("sy", y))]
    found = rows.filter(in_ring(width)).groupBy(*key, "w", "h").agg(*sums)
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    det = sxx * (syy * n - sy * sy) - sxy * (sxy * n - sy * sx) + sx * (sxy * sy - syy * sx)
    planes = found.withColumn("_det", F.when(det != 0, det))
    for c in CHANNELS:
        v, vx, vy = F.col(f"s{c}"), F.col(f"sx{c}"), F.col(f"sy{c}")
        planes = planes.withColumn(f"_a{c}", (vx * (syy * n - sy * sy) - sxy * (vy * n - sy * v) + sx * (vy * sy - syy * v)) / F.col("_det"))
        planes = planes.withColumn(f"_b{c}", (sxx * (vy * n - v * sy) - vx * (sxy * n - sy * sx) + sx * (sxy * v - vy * sx)) / F.col("_det"))
        planes = planes.withColumn(f"_c{c}", (sxx * (syy * v - sy * vy) - sxy * (sxy * v - vy * sx) + vx * (sxy * sy - syy * sx)) / F.col("_det"))
    ax = (F.col("_ar") + F.col("_ag") + F.col("_ab")) / 3
    by = (F.col("_br") + F.col("_bg") + F.col("_bb")) / 3
    right, bottom = (F.col("w") - 1).cast("double"), (F.col("h") - 1).cast("double")
    zero = F.lit(0.0)
    corners = F.array(*[F.struct((px * ax + py * by).alias("along"), F.lit(i).alias("i"), px.alias("px"), py.alias("py")) for i, (px, py) in enumerate(((zero, zero), (right, zero), (zero, bottom), (right, bottom)))])
    ends = planes.withColumn("_ends", F.array_sort(corners)).withColumn("_s", F.col("_ends")[0]).withColumn("_e", F.col("_ends")[3])

    def at(end: str, c: str) -> Column:
        return F.least(F.greatest(F.col(f"_a{c}") * F.col(f"{end}.px") + F.col(f"_b{c}") * F.col(f"{end}.py") + F.col(f"_c{c}"), zero), F.lit(255.0))

    return ends.select(*key, F.degrees(F.atan2(by, ax)).alias("angle"), *[at(end, c).alias(f"{name}_{c}") for name, end in (("start", "_s"), ("end", "_e")) for c in CHANNELS])


def _alike(a: str, b: str, tolerance: int) -> Column:
    return reduce(lambda p, q: p & q, [F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) <= tolerance for c in CHANNELS])


def regions_of_colour(pixels: DataFrame, key: list[str], tolerance: int) -> DataFrame:
    """key, x, y, region: pixels joined through neighbours (beside, above, below) that differ by at most ``tolerance`` in each channel.

    Pixels of a row that hang together are one run; runs of neighbouring rows are joined where two of their pixels touch and are
    alike; regions are the components of runs. ``region`` is the first run, a struct of row and place in it."""
    row = Window.partitionBy(*key, "y").orderBy("x")
    step = pixels.withColumns({f"_l{c}": F.lag(c).over(row) for c in CHANNELS}).withColumn("_lx", F.lag("x").over(row))
    joined = (F.col("x") - F.col("_lx") == 1) & _alike("", "_l", tolerance)
    runs = step.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(row).cast("int"))
    placed = runs.withColumn("_node", F.struct(*key, F.col("y").alias("_y"), F.col("_run").alias("_r")))
    below = placed.select(*key, "x", (F.col("y") - 1).alias("y"), *[F.col(c).alias(f"_b{c}") for c in CHANNELS], F.col("_node").alias("_below"))
    touching = placed.join(below, [*key, "x", "y"]).filter(_alike("", "_b", tolerance)).select(F.col("_node").alias("a"), F.col("_below").alias("b")).distinct()
    roots = star_components(touching).select(F.col("node").alias("_node"), "root")
    return placed.join(roots, "_node", "left").withColumn("_root", F.coalesce("root", "_node")).select(*key, "x", "y", F.struct(F.col("_root._y").alias("row"), F.col("_root._r").alias("run")).alias("region"))


def flood_fill(pixels: DataFrame, key: list[str], seeds: DataFrame, tolerance: int) -> DataFrame:
    """key, x0, y0, x1, y1 (first and last column and row) and ``area`` of the region that holds the seed (key, x, y) of each image."""
    regions = regions_of_colour(pixels, key, tolerance)
    wanted = regions.join(seeds.select(*key, "x", "y"), [*key, "x", "y"]).select(*key, "region")
    return regions.join(wanted, [*key, "region"]).groupBy(*key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area"))


def colour_delta(pixels: DataFrame, key: list[str], near: Column, variance: float = 20.0, delta: float = 25.0) -> DataFrame:
    """key, variance, delta, plain: whether the grey levels near a text vary little and their median colour stands apart from that of all."""
    grey = F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5)
    found = pixels.groupBy(*key).agg(F.var_pop(F.when(near, grey)).alias("variance"), *[F.median(F.when(near, F.col(c))).alias(f"_n{c}") for c in CHANNELS], *[F.median(c).alias(f"_f{c}") for c in CHANNELS])
    apart = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"_n{c}") - F.col(f"_f{c}")) * (F.col(f"_n{c}") - F.col(f"_f{c}")) for c in CHANNELS]))
    return found.select(*key, "variance", apart.alias("delta"), ((F.col("variance") <= variance) & (apart >= delta)).alias("plain"))
