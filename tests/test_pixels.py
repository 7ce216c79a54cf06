from __future__ import annotations

import random

import numpy as np
import pytest

from inkgrid.functions import kernels as K
from inkgrid.operators import pixels as P


def images(seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(12):
        h, w = int(rng.integers(1, 9)), int(rng.integers(1, 9))
        image = rng.integers(0, 6, (h, w, 3)) * 40
        if k % 3 == 0:
            image[:] = 200
            image[h // 2 :, w // 3 : w // 2 + 1] = 20
        out.append(image)
    return out


def table(spark, arrays):
    rows = [(k, x, y, *map(int, a[y, x])) for k, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "k int, x int, y int, r int, g int, b int").repartition(3)


def test_threshold_equals_the_histogram_loop(spark):
    rng = np.random.default_rng(2)
    levels = [rng.integers(0, 256, 300), np.array([7] * 5), rng.choice([3, 250], 100), np.array([0, 255])]
    frame = spark.createDataFrame([(k, int(v)) for k, a in enumerate(levels) for v in a], "k int, v int")
    got = {r["k"]: r["threshold"] for r in P.otsu_threshold(frame, ["k"], "v").collect()}
    for k, values in enumerate(levels):
        best, at = 0.0, 0
        for t in range(256):
            lo, hi = values[values <= t], values[values > t]
            if len(lo) and len(hi) and (v := len(lo) * len(hi) * (lo.mean() - hi.mean()) ** 2) > best * (1 + 1e-12):
                best, at = v, t
        assert got[k] == at


def test_alpha_equals_the_array_form(spark):
    arrays = images()
    got = {(r["k"], r["y"], r["x"]): r["alpha"] for r in P.flat_alpha(table(spark, arrays), ["k"]).collect()}
    for k, a in enumerate(arrays):
        want = K.flat_alpha(a.astype(float))
        for (y, x), v in np.ndenumerate(want):
            assert got[k, y, x] == pytest.approx(float(v), abs=1e-6)


def test_plane_equals_least_squares(spark):
    arrays = images(3)
    got = {r["k"]: r for r in P.gradient_plane(table(spark, arrays), ["k"]).collect()}
    for k, a in enumerate(arrays):
        h, w, _ = a.shape
        ring = min(3, h // 2, w // 2) or 1
        y, x = np.nonzero([[i < ring or j < ring or i >= h - ring or j >= w - ring for j in range(w)] for i in range(h)])
        if h == 1 or w == 1 or len(x) < 3:
            assert got[k]["angle"] is None
            continue
        plane = np.linalg.lstsq(np.column_stack((x, y, np.ones(len(x)))), a[y, x].astype(float), rcond=None)[0]
        along = [float(px * plane[0].mean() + py * plane[1].mean()) for px, py in ((0, 0), (w - 1, 0), (0, h - 1), (w - 1, h - 1))]
        if len({round(v, 6) for v in along}) < 4:
            continue  # ties among corners are broken by rounding there
        corners = [(0, 0), (w - 1, 0), (0, h - 1), (w - 1, h - 1)]
        for name, (px, py) in (("start", corners[int(np.argmin(along))]), ("end", corners[int(np.argmax(along))])):
            assert [got[k][f"{name}_{c}"] for c in "rgb"] == pytest.approx(np.clip(np.array([px, py, 1]) @ plane, 0, 255).tolist(), abs=1e-6)
        assert got[k]["angle"] == pytest.approx(float(np.degrees(np.arctan2(plane[1].mean(), plane[0].mean()))), abs=1e-6)


@pytest.mark.parametrize("tolerance", [0, 40, 80])
def test_flood_fill_equals_a_plain_one(spark, tolerance):
    arrays = images(4) + [np.array([[[v] * 3 for v in row] for row in ([0, 9, 0, 9, 0], [0, 9, 0, 9, 0], [0, 0, 0, 9, 0], [9, 9, 9, 9, 0], [0, 0, 0, 0, 0])])]
    seeds = [(k, k % a.shape[1], k % a.shape[0]) for k, a in enumerate(arrays)]
    got = {r["k"]: tuple(r)[1:] for r in P.flood_fill(table(spark, arrays), ["k"], spark.createDataFrame(seeds, "k int, x int, y int"), tolerance).collect()}
    for k, sx, sy in seeds:
        a = arrays[k].astype(int)
        seen, todo = {(sy, sx)}, [(sy, sx)]
        while todo:
            y, x = todo.pop()
            for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= v < a.shape[0] and 0 <= u < a.shape[1] and (v, u) not in seen and (abs(a[v, u] - a[y, x]) <= tolerance).all():
                    seen.add((v, u))
                    todo.append((v, u))
        ys, xs = zip(*seen)
        assert got[k] == (min(xs), min(ys), max(xs), max(ys), len(seen))


def test_empty_and_missing_seeds(spark):
    frame = table(spark, images(5)[:2])
    none = spark.createDataFrame([], "k int, x int, y int")
    assert P.flood_fill(frame, ["k"], none, 10).count() == 0 and P.flat_alpha(frame.filter("false"), ["k"]).count() == 0
    assert P.flood_fill(frame, ["k"], spark.createDataFrame([(0, 99, 99)], "k int, x int, y int"), 10).count() == 0
