from __future__ import annotations

import datetime

import pytest

from inkgrid import plans


def test_masks_of_all_pairs(spark, tmp_path):
    rows = [(i, [1.0 if (i >> (k % 4)) & 1 else -1.0 for k in range(64)]) for i in range(9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    signs = [{k for k, x in enumerate(v) if x > 0} for _, v in rows]
    want = {i: len(a & b) / len(a | b) if a | b else 1.0 for i, (a, b) in enumerate(zip(signs[:-1], signs[1:], strict=True))}
    got = {r["vec_id"]: r["iou"] for r in plans.QUERIES["x01_mask_iou"](spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(v, abs=1e-6) for i, v in want.items()} and len(got) == 8


def test_ink_runs_of_all_lines(spark, tmp_path):
    day = datetime.date(1996, 1, 1)
    rows = [(o, 1, p, 1, float(q), 1.0, "A", "F", day) for o, p, q in [(1, 3, 5), (2, 4, 9)]]
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for o, _, p, _, q, *_ in rows:
        ink = [c for c in range(p % 40, p % 40 + 20 + int(q)) if c % 7 < 4]
        starts = [c for k, c in enumerate(ink) if not k or c - ink[k - 1] > 3]
        want[o] = [(a, max(c for c in ink if c < b)) for a, b in zip(starts, [*starts[1:], 10**6], strict=True)]
    got = {}
    for r in plans.QUERIES["w09_ink_runs"](spark, str(tmp_path)).collect():
        got.setdefault(r["image_id"], []).append((r["first"], r["last"]))
    assert {o: sorted(v) for o, v in got.items()} == want
