"""Box geometry as Column expressions. A box is a struct<x, y, w, h> of doubles; a crop a struct<x0, y0, x1, y1> of ints.

Everything stays inside whole-stage code generation but for the functions over arrays of boxes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"


def box(x, y, w, h) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, (int, float)) else v).cast("double").alias(n) for n, v in zip("xywh", (x, y, w, h), strict=True)])


def right(b: Column) -> Column:
    return b["x"] + b["w"]


def bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def centre_x(b: Column) -> Column:
    return b["x"] + b["w"] / 2


def centre_y(b: Column) -> Column:
    return b["y"] + b["h"] / 2


def area(b: Column) -> Column:
    """Negative sides count as nothing."""
    zero = F.lit(0.0)
    return F.greatest(b["w"], zero) * F.greatest(b["h"], zero)


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    across = F.greatest(F.least(right(a), right(b)) - F.greatest(a["x"], b["x"]), zero)
    return across * F.greatest(F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"]), zero)


def near(a: Column, b: Column) -> Column:
    """False where two boxes surely share no area: a quick look before ``intersection``. True where an edge is not known."""
    return F.coalesce((a["y"] < bottom(b)) & (b["y"] < bottom(a)) & (a["x"] < right(b)) & (b["x"] < right(a)), F.lit(True))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; two boxes without area give 0."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def overlap_min(a: Column, b: Column) -> Column:
    """Intersection over the smaller area, 0 if that is 0."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def _clip(b: Column, regions: Column) -> Column:
    """Edges of what each region shares with the box, empty ones left out."""
    cut = F.transform(regions, lambda r: F.struct(F.greatest(b["x"], r["x"]).alias("x0"), F.greatest(b["y"], r["y"]).alias("y0"), F.least(right(b), right(r)).alias("x1"), F.least(bottom(b), bottom(r)).alias("y1")))
    return F.filter(cut, lambda c: (c["x1"] > c["x0"]) & (c["y1"] > c["y0"]))


def union_area_within(b: Column, regions: Column) -> Column:
    """Exact area of the box covered by any region: the sum over x slabs of the slab's width times the length
    of the merged y intervals of the regions that span it."""

    def within(cuts: Column) -> Column:
        xs = F.array_sort(F.array_distinct(F.concat(F.transform(cuts, lambda c: c["x0"]), F.transform(cuts, lambda c: c["x1"]))))
        slabs = F.zip_with(xs, F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(1))), lambda a, c: F.struct(a.alias("a"), c.alias("c")))

        def covered(slab: Column) -> Column:
            spans = F.array_sort(F.transform(F.filter(cuts, lambda c: (c["x0"] <= slab["a"]) & (c["x1"] >= slab["c"])), lambda c: F.struct(c["y0"].alias("a"), c["y1"].alias("c"))))
            start = F.struct(F.lit(float("-inf")).alias("end"), F.lit(0.0).alias("total"))
            merged = F.aggregate(spans, start, lambda s, v: F.struct(F.greatest(s["end"], v["c"]).alias("end"), (s["total"] + F.greatest(v["c"] - F.greatest(v["a"], s["end"]), F.lit(0.0))).alias("total")))
            return merged["total"] * (slab["c"] - slab["a"])

        sums = F.transform(F.filter(slabs, lambda s: s["c"].isNotNull()), covered)
        one = F.get(cuts, 0)
        return F.when(F.size(cuts) == 0, 0.0).when(F.size(cuts) == 1, (one["y1"] - one["y0"]) * (one["x1"] - one["x0"])).otherwise(F.aggregate(sums, F.lit(0.0), lambda s, v: s + v))

    # a variable of a lambda is computed once
    return F.get(F.transform(F.array(_clip(b, regions)), within), 0)


def fraction_in_regions(b: Column, regions: Column) -> Column:
    """Covered share of the box; a box without area counts as inside if its centre is (edges included)."""
    inside = F.exists(regions, lambda r: centre_x(b).between(r["x"], right(r)) & centre_y(b).between(r["y"], bottom(r)))
    return F.when(area(b) == 0, F.when(inside, 1.0).otherwise(0.0)).otherwise(union_area_within(b, regions) / area(b))


def quad_to_box(quad: Column) -> Column:
    """Bounding box of an array of struct<x, y>."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def union_box(boxes: Column) -> Column:
    """Box around an array of boxes."""
    x0, y0 = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    return box(x0, y0, F.array_max(F.transform(boxes, right)) - x0, F.array_max(F.transform(boxes, bottom)) - y0)


def scale(b: Column, k) -> Column:
    return box(b["x"] * k, b["y"] * k, b["w"] * k, b["h"] * k)


def padded_region(b: Column, pad: int, width: Column, height: Column) -> Column:
    """Crop that holds the box and ``pad`` pixels around it, within the image."""
    return _crop(F.greatest(F.floor(b["x"]) - pad, F.lit(0)), F.greatest(F.floor(b["y"]) - pad, F.lit(0)), F.least(F.ceil(right(b)) + pad, width), F.least(F.ceil(bottom(b)) + pad, height))


def clamped_crop(b: Column, bounds: Column, pad: int, width: Column, height: Column) -> Column:
    """Crop of the truncated padded box, never over ``bounds`` (struct of min_x, max_x, min_y, max_y), which round inwards."""
    x0 = F.greatest(F.lit(0), (b["x"] - pad).cast("int"), F.ceil(bounds["min_x"]))
    y0 = F.greatest(F.lit(0), (b["y"] - pad).cast("int"), F.ceil(bounds["min_y"]))
    x1 = F.least(width, (right(b) + pad).cast("int"), F.floor(F.least(bounds["max_x"], F.lit(2.0**31 - 1))))
    y1 = F.least(height, (bottom(b) + pad).cast("int"), F.floor(F.least(bounds["max_y"], F.lit(2.0**31 - 1))))
    return _crop(x0, y0, x1, y1)


def _crop(x0, y0, x1, y1) -> Column:
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def expand_crop(alignment: Column, c: Column, text_width: Column, image_width: Column) -> Column:
    """Room for a wider text: to the left if it is right-aligned, to both sides if centred (what the left edge
    of the image refuses goes to the right), else to the right."""
    extra = text_width - (c["x1"] - c["x0"])
    to_left = F.greatest(F.lit(0.0), c["x0"] - extra)
    half_left = F.greatest(F.lit(0.0), c["x0"] - extra / 2)
    rest = F.greatest(F.lit(0.0), extra / 2 - (c["x0"] - half_left))
    wide = image_width.cast("double")
    x0 = F.when(alignment == "right", to_left).when(alignment == "center", half_left).otherwise(c["x0"])
    x1 = F.when(alignment == "right", c["x1"]).when(alignment == "center", F.least(wide, c["x1"] + extra / 2 + rest)).otherwise(F.least(wide, c["x1"] + extra))
    return F.when(extra <= 0, _crop(c["x0"], c["y0"], c["x1"], c["y1"])).otherwise(_crop(x0, c["y0"], x1, c["y1"]))


def translate_crop(c: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """Moved crop of the same size, kept on the image."""
    w, h = c["x1"] - c["x0"], c["y1"] - c["y0"]
    x0 = F.greatest(F.lit(0.0), F.least(c["x0"] + dx, (width - w).cast("double"))).cast("int")
    y0 = F.greatest(F.lit(0.0), F.least(c["y0"] + dy, (height - h).cast("double"))).cast("int")
    return _crop(x0, y0, x0 + w, y0 + h)


def alignment_offset(alignment: Column, available: Column, text_width: Column, base: Column) -> Column:
    return F.when(alignment == "center", (available - text_width) / 2).when(alignment == "right", available - text_width).otherwise(base)


def fit_size(size: Column, text_width: Column, max_width: Column, least_ratio: float = 0.5) -> Column:
    """struct<size, overflow>: the size at which the text fits, not below ``least_ratio`` of it."""
    fitted, floor = size * max_width / text_width, size * least_ratio
    fits = (text_width <= max_width) | (text_width == 0)
    return F.struct(F.when(fits, size).otherwise(F.greatest(fitted, floor)).alias("size"), F.when(fits, F.lit(False)).otherwise(fitted < floor).alias("overflow"))


def normalised_offset(gt: Column, pred: Column) -> Column:
    """struct<dx, dy>: distance of the centres in heights of the first box; null for no height."""
    tall = F.when(gt["h"] != 0, gt["h"])
    return F.struct(((centre_x(pred) - centre_x(gt)) / tall).alias("dx"), ((centre_y(pred) - centre_y(gt)) / tall).alias("dy"))


def contained_within(inner: Column, outer: Column, slack: float = 2.0) -> Column:
    """Inner box within the outer one, rounded outwards, by ``slack``."""
    return (inner["x"] >= F.floor(outer["x"]) - slack) & (inner["y"] >= F.floor(outer["y"]) - slack) & (right(inner) <= F.ceil(right(outer)) + slack) & (bottom(inner) <= F.ceil(bottom(outer)) + slack)


def scale_deviation(one: Column, scaled: Column, k) -> Column:
    """Largest edge distance between a box at scale k and k times the box at scale 1."""
    return F.greatest(F.abs(scaled["x"] - one["x"] * k), F.abs(scaled["y"] - one["y"] * k), F.abs(right(scaled) - right(one) * k), F.abs(bottom(scaled) - bottom(one) * k))


def gradient_at(stops: Column, at: Column, channel: str) -> Column:
    """Value of ``channel`` at a position between sorted stops, linear, rounded half up; ends hold beyond."""
    ordered = F.array_sort(F.transform(stops, lambda s: F.struct(s["position"].alias("position"), s[channel].cast("double").alias("value"))))
    below = F.filter(ordered, lambda s: s["position"] <= at)
    above = F.filter(ordered, lambda s: s["position"] > at)
    lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    span = hi["position"] - lo["position"]
    value = F.when(lo.isNull(), hi["value"]).when(hi.isNull(), lo["value"]).otherwise(lo["value"] + (hi["value"] - lo["value"]) * (at - lo["position"]) / span)
    return F.floor(value + 0.5).cast("int")


def place_handle(target: Column, size: float, gap: float, width: Column, height: Column, others: Column) -> Column:
    """Corner for a square handle: of above-left, above-right, below-left and below-right the first that fits the
    image and covers no other box, else the first that fits, else above-left."""
    lefts, tops = (target["x"], right(target) - size), (target["y"] - gap - size, bottom(target) + gap)
    spots = F.array(*[box(x, y, size, size) for y in tops for x in lefts])
    fitting = F.filter(spots, lambda s: (s["x"] >= 0) & (s["y"] >= 0) & (right(s) <= width) & (bottom(s) <= height))
    free = F.filter(fitting, lambda s: ~F.exists(others, lambda o: intersection(s, o) > 0))
    return F.coalesce(F.try_element_at(free, F.lit(1)), F.try_element_at(fitting, F.lit(1)), F.element_at(spots, 1))
