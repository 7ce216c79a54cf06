from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkgrid.streaming import timed

START = datetime(2024, 1, 1)


def plain_gate(rows):
    """Outcomes by a loop over all messages of a session in order."""
    out = []
    for session in sorted({r[0] for r in rows}):
        status, held = {}, []
        for _, at, i, body in sorted((r for r in rows if r[0] == session), key=lambda r: (r[1], r[2])):
            m = json.loads(body)
            done = {}
            if m["kind"] == "detected":
                done = {n: "dropped" for _, n, _ in held}
                status = {n: "pending" for n in m["names"]}
            elif m["kind"] == "region":
                status[m["region"]] = "ready"
                done = {m["region"]: "waited"}
            elif m["kind"] == "error":
                done = {n: "rejected" for n, s in status.items() if s == "pending"}
                status.update(dict.fromkeys(done, "failed"))
            elif status.get(m["region"]) == "pending":
                held.append((i, m["region"], at))
            else:
                out.append((session, i, m["region"], "at_once" if status.get(m["region"]) == "ready" else "rejected", 0))
            out += [(session, e, n, done[n], (at - asked) // timedelta(milliseconds=1)) for e, n, asked in held if n in done]
            held = [h for h in held if h[1] not in done]
    return sorted(out)


def plain_quiet(rows, quiet):
    out = []
    for session in sorted({r[0] for r in rows}):
        mine = sorted((r[1], r[2]) for r in rows if r[0] == session)
        n = 0
        for k, (at, i) in enumerate(mine):
            n += 1
            if k + 1 == len(mine) or mine[k + 1][0] - at >= quiet:
                out.append((session, i, n))
                n = 0
    return sorted(out)


def messages(seed, n):
    rng = random.Random(seed)
    rows, at = [], START
    for i in range(n):
        at += timedelta(microseconds=rng.choice([0, 1, 449_999, 450_000, 450_001, 1_000_000]))
        kind = rng.choice(["detected", "region", "region", "edit", "edit", "edit", "error"])
        rows.append((rng.choice("ab"), at, i, json.dumps({"kind": kind, "region": rng.choice(["r0", "r1", "r9"]), "names": ["r0", "r1"]})))
    return rows


def streamed(spark, folder, batches, processor, delay):
    """One file a trigger, in the order of ``batches``; the end of time behind them, twice so that timers fire."""
    end = [("", START + timedelta(days=9000), 0, '{"kind": "end", "n": 0}')]
    for rows in [*batches, end, end]:
        spark.createDataFrame(rows, timed.MESSAGE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(timed.MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return sorted(map(tuple, timed.run_stream(spark, timed.settled(source, processor, delay), f"{folder}/run").filter("session <> ''").collect()))


def orders(rows):
    """In order in three triggers; backwards; dealt at random."""
    third = len(rows) // 3 + 1
    mixed = random.Random(0).sample(rows, len(rows))
    return {"forwards": [rows[i : i + third] for i in range(0, len(rows), third)], "backwards": [rows[::-1][i : i + third] for i in range(0, len(rows), third)], "mixed": [mixed[i : i + third] for i in range(0, len(rows), third)]}


@pytest.mark.parametrize("order", ["forwards", "backwards", "mixed"])
def test_gate_does_not_depend_on_arrival(spark, tmp_path, order):
    rows = messages(1, 160)
    got = streamed(spark, tmp_path, orders(rows)[order], timed.Gate(), "1 day")
    assert got == plain_gate(rows) and {r[3] for r in got} == {"at_once", "waited", "rejected", "dropped"}


@pytest.mark.parametrize("order", ["forwards", "backwards", "mixed"])
def test_quiet_does_not_depend_on_arrival(spark, tmp_path, order):
    rows = messages(2, 120)
    assert streamed(spark, tmp_path, orders(rows)[order], timed.Quiet(450), "1 day") == plain_quiet(rows, timedelta(milliseconds=450))


def test_gate_answers_while_the_stream_runs(spark, tmp_path):
    """With a short delay what is settled leaves before the end, and stays what it is."""
    rows = messages(3, 90)
    assert streamed(spark, tmp_path, orders(rows)["forwards"], timed.Gate(), "1 second") == plain_gate(rows)


def test_barrier(spark, tmp_path):
    def member(s, k, x, n):
        return (s, START + timedelta(seconds=k), k, json.dumps({"x": x, "y": 20 * k, "w": 10 + k, "n": n}))

    whole, never = [member("whole", k, 5, 4) for k in range(4)], [member("never", k, 10 - k, 3) for k in range(2)]
    one = [member("one", 0, 3, 1)]
    got = streamed(spark, tmp_path, [whole[:1] + never, [whole[3]] + one, whole[1:3]], timed.Barrier(60_000), "1 day")
    assert got == [("never", 2, "right", 20.0, False), ("one", 1, "left", None, True), ("whole", 4, "left", 20.0, True)]


def test_table_as_a_stream(spark):
    rows = [("a", START, 1, "{}"), ("a", START + timedelta(seconds=9), 2, "{}"), (None, START, 3, "{}"), ("", START, 4, "{}"), ("b", START, 5, None)]
    frame = spark.createDataFrame(rows, timed.MESSAGE).withColumn("burst", F.lit("x"))
    assert sorted(map(tuple, timed.stream_table(frame, timed.Quiet(), "1 day").collect())) == [("a", 1, 1), ("a", 2, 1), ("b", 5, 1)]


def test_empty_table(spark):
    assert timed.stream_table(spark.createDataFrame([], timed.MESSAGE), timed.Quiet(), "1 day").collect() == []
