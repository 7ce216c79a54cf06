from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.functions import geometry as G
from inkgrid.functions import kernels as K
from inkgrid.functions import numeric as N
from inkgrid.functions import text as X


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in KINDS(values))) if values else spark.range(1)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def KINDS(values):
    kinds = {str: "string", float: "double", int: "long", bool: "boolean"}
    return [(n, kinds[type(v)]) for n, v in values.items()]


def b(x, y, w, h):
    return G.box(float(x), float(y), float(w), float(h))


def test_box_measures(spark):
    got = one(spark, G.iou(b(0, 0, 10, 10), b(5, 0, 10, 10)), G.overlap_min(b(0, 0, 20, 20), b(5, 0, 20, 20)), G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)), G.area(b(0, 0, -3, 5)), G.intersection(b(0, 0, 5, 5), b(9, 9, 5, 5)))
    assert tuple(got) == (pytest.approx(50 / 150), 0.75, 0.0, 0.0, 0.0)


def test_naive_half_boxes_do_not_match(spark):
    """A box of a 40 x 40 region at half size is not half its rounded box."""
    assert one(spark, G.iou(b(10, 10, 40, 40), b(10, 10, 43, 48)))[0] == pytest.approx(1600 / 2064)


def test_union_area_equals_counting(spark):
    rng = random.Random(1)
    cases = []
    for _ in range(40):
        box = (rng.randint(0, 5), rng.randint(0, 5), rng.randint(0, 9), rng.randint(0, 9))
        cases.append((box, [(rng.randint(-3, 9), rng.randint(-3, 9), rng.randint(0, 7), rng.randint(0, 7)) for _ in range(rng.randint(0, 6))]))
    rows = [(i, tuple(map(float, box)), [tuple(map(float, r)) for r in regions]) for i, (box, regions) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, b {G.BOX}, r array<{G.BOX}>")
    got = {r["i"]: r["a"] for r in df.select("i", G.union_area_within(F.col("b"), F.col("r")).alias("a")).collect()}
    for i, ((x, y, w, h), regions) in enumerate(cases):
        cells = {(p, q) for p in range(x, x + w) for q in range(y, y + h) if any(u <= p < u + s and v <= q < v + t for u, v, s, t in regions)}
        assert got[i] == len(cells)


def test_fraction_of_a_point(spark):
    regions = F.array(b(0, 0, 4, 4))
    assert tuple(one(spark, G.fraction_in_regions(b(2, 2, 0, 0), regions), G.fraction_in_regions(b(9, 9, 0, 5), regions), G.fraction_in_regions(b(0, 0, 8, 4), regions))) == (1.0, 0.0, 0.5)


def crop(x0, y0, x1, y1):
    return F.struct(*[F.lit(v).cast("int").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def test_expand_and_translate(spark):
    grow = lambda a, c, w, image: tuple(one(spark, G.expand_crop(F.lit(a), crop(*c), F.lit(float(w)), F.lit(image)))[0])
    assert grow("left", (10, 10, 60, 30), 90, 200) == (10, 10, 100, 30)
    assert grow("right", (100, 10, 150, 30), 90, 200) == (60, 10, 150, 30)
    assert grow("center", (75, 10, 125, 30), 80, 200) == (60, 10, 140, 30)
    assert grow("center", (5, 10, 55, 30), 80, 200) == (0, 10, 80, 30), "what the left edge refuses goes to the right"
    assert grow("left", (10, 10, 60, 30), 20, 200) == (10, 10, 60, 30)
    moved = one(spark, G.translate_crop(crop(10, 10, 30, 20), F.lit(-50.0), F.lit(500.0), F.lit(100), F.lit(100)))[0]
    assert tuple(moved) == (0, 90, 20, 100)


def test_fit_size(spark):
    got = one(spark, G.fit_size(F.lit(20.0), F.lit(100.0), F.lit(80.0)), G.fit_size(F.lit(20.0), F.lit(100.0), F.lit(10.0)), G.fit_size(F.lit(20.0), F.lit(100.0), F.lit(100.0)))
    assert [tuple(g) for g in got] == [(16.0, False), (10.0, True), (20.0, False)]


def test_handle_places(spark):
    spot = lambda others: tuple(one(spark, G.place_handle(b(20, 20, 30, 10), 5.0, 2.0, F.lit(100.0), F.lit(100.0), F.array(*others) if others else F.array().cast(f"array<{G.BOX}>")))[0])
    assert spot([]) == (20.0, 13.0, 5.0, 5.0)
    assert spot([b(18, 10, 10, 9)]) == (45.0, 13.0, 5.0, 5.0)


def test_quad_and_union(spark):
    quad = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((3.0, 1.0), (9.0, 2.0), (8.0, 7.0), (2.0, 6.0))])
    assert tuple(one(spark, G.quad_to_box(quad))[0]) == (2.0, 1.0, 7.0, 6.0)
    assert tuple(one(spark, G.union_box(F.array(b(0, 0, 2, 2), b(5, 5, 1, 3))))[0]) == (0.0, 0.0, 6.0, 8.0)


# ---------------------------------------------------------------- text


@pytest.mark.parametrize(("raw", "normal"), [("a b", "a b"), ("‘x’ “y”", "'x' \"y\""), ("3″", "3''"), ("co­op", "coop"), ("a—b", "a-b"), (" a \t\n b ", "a b"), ("ﬁx", "fix"), ("A​B", "AB"), ("", ""), (None, None)])
def test_normal_form(raw, normal):
    assert X.normal_form(raw) == normal


def test_normal_forms_in_spark(spark):
    df = spark.createDataFrame([("Straße ",), (None,), ("SUPPORT",)], "t string")
    got = df.select(X.n1("t").alias("a"), X.n2("t").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [("Straße", "strasse"), (None, None), ("SUPPORT", "support")]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_substitutions():
    rng = random.Random(0)
    for _ in range(200):
        a, b_ = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        d = levenshtein(a, b_)
        assert X.edit_distance(list(a), list(b_)) == d
        subs = X.substitutions(a, b_)
        assert len(subs) <= d and all(a[i] == x and b_[j] == y and x != y for i, j, x, y in subs)
    assert X.substitutions("platform nine", "plalform mine") == [(3, 3, "t", "l"), (9, 9, "n", "m")]
    assert X.substitutions("timetable", "timtabble") == []


def test_error_rates(spark):
    rate = lambda r, h: tuple(one(spark, X.error_rate(F.levenshtein(F.lit(r), F.lit(h)), F.length(F.lit(r))), X.bench_error_rate(F.lit(r), F.lit(h))))
    assert rate("quay", "quey") == (0.25, 0.25) and rate("", "") == (None, 0.0) and rate("", "x") == (None, 1.0)
    tokens = lambda t: X.tokens(F.lit(t))
    assert one(spark, X.bag_of_words_f1(tokens("a b c"), tokens("a b d e")))[0] == pytest.approx(4 / 7)
    assert one(spark, X.bag_of_words_f1(tokens(""), tokens("")))[0] == 1.0
    assert tuple(one(spark, X.numeric_matches(tokens("1 1 x 2"), tokens("1 2 2")))[0]) == (3, 2)


def test_classes_and_colours(spark):
    case = lambda t: one(spark, X.letter_case(F.lit(t)))[0]
    assert [case(t) for t in ("12", "ABC", "abc", "Send Feedback", "sEND", "ÉTÉ")] == ["no_letters", "upper", "lower", "title", "mixed", "upper"]
    assert tuple(one(spark, X.hex_to_rgb(F.lit("#0a0B0c")))[0]) == (10, 11, 12) and tuple(one(spark, X.hex_to_rgb(F.lit("#zz")))[0]) == (0, 0, 0)
    assert one(spark, X.rgb_to_hex(F.lit(300), F.lit(-4), F.lit(10)))[0] == "#ff000a"
    assert one(spark, X.css_colour(F.lit("rgba(1, 2, 3, 0.5)")))[0] == [1, 2, 3, 0.5] and one(spark, X.css_colour(F.lit("red")))[0] is None
    assert one(spark, X.first_font_family(F.lit("'Open Sans', serif")))[0] == "Open Sans"
    assert one(spark, X.base_id(F.lit("t"), F.lit(1.5), F.lit("dark")), X.base_id(F.lit("t"), F.lit(1.0), F.lit("dark"))) == ("t_dpr1p5_dark", "t_dpr1_dark")


# ---------------------------------------------------------------- numbers


def test_rules(spark):
    lit = lambda v: F.lit(v).cast("double")
    assert one(spark, N.calibrated(lit(0.6)), N.calibrated(lit(0.1)), N.region_confidence(lit(0.4), lit(0.9))) == (pytest.approx(0.5), 0.0, 0.4)
    assert one(spark, *[N.confidence_level(lit(v)) for v in (None, 0.95, 0.85, 0.2)]) == ("none", "none", "quiet", "warning")
    assert one(spark, *[N.margin_level(lit(v)) for v in (None, 0.05, 0.02, 0.0)]) == ("n/a", "certain", "likely", "uncertain")
    assert one(spark, *[N.scale_bucket(lit(v)) for v in (None, 2.1, 2.2, 4.2)]) == (1, 1, 2, 3)
    white, black = [lit(255)] * 3, [lit(0)] * 3
    assert one(spark, N.contrast_ratio(black, lit(1), white), N.contrast_ratio(black, lit(0), white)) == (21.0, 1.0)
    assert one(spark, N.psnr(lit(0)), N.psnr(lit(65025))) == (None, 0.0)
    assert one(spark, N.f1(lit(0), lit(1)), N.f1(lit(None), lit(1)), N.f1(lit(0.5), lit(1))) == (0.0, 0.0, pytest.approx(2 / 3))


# ---------------------------------------------------------------- kernels


def test_masks_and_similarity():
    rng = np.random.default_rng(0)
    a, c = rng.random((12, 15)), rng.random((12, 15))
    assert K.mask_iou(np.zeros((3, 3)), np.zeros((3, 3))) == 1.0 and K.ssim(a, a) == pytest.approx(1)
    w, k1, k2 = 7, 0.01**2, 0.03**2
    values = []
    for i in range(12 - w + 1):
        for j in range(15 - w + 1):
            p, q = a[i : i + w, j : j + w].ravel(), c[i : i + w, j : j + w].ravel()
            cov = np.cov(p, q)
            values.append((2 * p.mean() * q.mean() + k1) * (2 * cov[0, 1] + k2) / ((p.mean() ** 2 + q.mean() ** 2 + k1) * (cov[0, 0] + cov[1, 1] + k2)))
    assert K.ssim(a, c) == pytest.approx(np.mean(values))
    with pytest.raises(ValueError):
        K.ssim(a[:5], c[:5])
    assert K.blended_score(a[:5], c[:5]) == pytest.approx(K.mask_iou(a[:5], c[:5]))


def test_regions_and_distances():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool)
    label, n = K.label_regions(mask)
    assert n == 3 and label[0, 0] == label[1, 1] != label[0, 3]
    rng = np.random.default_rng(1)
    m = rng.random((9, 11)) < 0.7
    bare = np.argwhere(~m)
    want = np.array([[0 if not m[y, x] else np.sqrt(((bare - (y, x)) ** 2).sum(axis=1).min()) for x in range(11)] for y in range(9)])
    assert np.allclose(K.distance_inside(m), want)
    assert K.flood_bounds(mask, 0, 0) == (0, 0, 1, 1) and K.flood_bounds(mask, 0, 1) is None
    assert K.clean_mask(np.pad([[1.0]], 3)).sum() == 0 and K.clean_mask(np.pad([[1.0, 1.0]], 3)).sum() == 12


def test_images():
    y, x = np.mgrid[:10, :20]
    grad = np.stack([x * 10.0, x * 10.0, x * 10.0], axis=2)
    found = K.linear_gradient(grad)
    assert found["angle"] == pytest.approx(0, abs=1e-6) and found["start"][0] == pytest.approx(0, abs=1e-6) and found["end"][0] == pytest.approx(190)
    assert np.allclose(K.linear_fill(10, 20, 0, [(1, [190.0] * 3), (0, [0.0] * 3)]), grad)
    crop_ = np.full((12, 12, 3), 200.0)
    crop_[5:7, 3:9] = 20
    alpha = K.flat_alpha(crop_)
    assert alpha[5, 4] == pytest.approx(1) and alpha[0, 0] == 0
    assert K.text_and_ground(crop_, alpha) == ([20, 20, 20], [200, 200, 200])
    assert K.pixel_difference(crop_, crop_)["count"] == 0
    other = crop_.copy()
    other[2, 3] += 1
    assert K.pixel_difference(crop_, other) == {"count": 1, "x0": 3, "y0": 2, "x1": 4, "y1": 3}
    assert np.allclose(K.erased(crop_, alpha > 0.5), 200)
    rng = np.random.default_rng(0)
    a = rng.random((32, 32))
    dx, dy = K.phase_shift(a, np.roll(a, (3, -2), axis=(0, 1)))
    assert (round(dx), round(dy)) == (-2, 3)
    assert K.minimise(lambda v: (v - 2) ** 2, 0, 5)[0] == pytest.approx(2, abs=0.01) and K.minimise(lambda v: v, 3, 1) == (3, 3)
    assert K.median_run(np.array([[1, 1, 0, 1], [0, 0, 0, 0]])) == 1.5 and K.stroke_width(np.zeros((3, 3), bool)) is None
    jpeg = bytes.fromhex("ffd8ffc0001108001000100301220002110103110100")
    assert K.jpeg_sampling(jpeg) == "4:2:0" and K.jpeg_sampling(b"png") is None


def test_band_place_and_control():
    ink = np.zeros((10, 8))
    ink[1, 3] = ink[8, 3] = 1
    ink[3:7, 1:7] = 1
    assert K.core_band(ink) == 4 / 8 and K.core_band(np.zeros((3, 3))) is None
    target = np.zeros((12, 12))
    target[4:8, 5:9] = 1
    shifted = lambda p: np.roll(target, int(p), axis=1)
    assert K.best_place(target, shifted, [-2, -1, 0, 1, 2]) == (0, pytest.approx(1.0))
    image = np.full((60, 80, 3), 250.0)
    image[20:40, 20:60] = (40, 80, 120)
    found = K.control_behind(image, (30, 26, 20, 8), near=2, far=25, tolerance=5)
    assert found == {"x": 20, "y": 20, "w": 40, "h": 20, "rgb": [120, 80, 40]}
    assert K.control_behind(image, (5, 5, 5, 5), near=2, far=8, tolerance=5) is None
    assert K.control_behind(image, (15, 15, 20, 20), near=2, far=20, tolerance=5) is None, "not plain"


def test_normal_forms_hold_few_texts_at_once():
    """Of a batch of long texts only some are Python strings at a time."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, "", *[f"{k}’ café  " * 400 for k in range(1500)]])
    tracemalloc.start()
    found = X._n2.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist()[:3] == [None, "", X.normal_form(texts[2].as_py()).casefold()] and len(found) == len(texts)
    assert peak < 4e6  # all texts as strings are 20 MB
