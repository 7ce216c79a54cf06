from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from inkgrid.functions import geometry as G
from inkgrid.sources import readers, writers
from inkgrid.streaming import regions as R


def test_json_lines_with_mark_and_blanks(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("﻿" + json.dumps({"rep": 1, "image_id": "a"}) + "\n\n" + json.dumps({"rep": 2}) + "\nbroken\n", encoding="utf8")
    rows = readers.timings(spark, str(tmp_path / "t.jsonl")).collect()
    assert sorted((r["rep"] or 0, r["image_id"]) for r in rows) == [(0, None), (1, "a"), (2, None)] and sum(r["_corrupt"] is not None for r in rows) == 1


def test_prediction_tree(spark, tmp_path):
    for engine, n in (("one", 2), ("two", 1)):
        (tmp_path / engine).mkdir()
        for i in range(n):
            (tmp_path / engine / f"{i}.json").write_text(json.dumps({"image_id": f"i{i}", "status": "ok", "lines": [{"bbox": [1, 2, 3, 4], "text": "x", "confidence": None}]}, indent=1))
    docs = readers.predictions(spark, str(tmp_path))
    lines = readers.prediction_lines(docs).collect()
    assert sorted((r["engine_id"], r["image_id"], r["p"], tuple(r["b"])) for r in lines) == [("one", "i0", 0, (1, 2, 3, 4)), ("one", "i1", 0, (1, 2, 3, 4)), ("two", "i0", 0, (1, 2, 3, 4))]
    assert docs.first()["memory_limit"] is None


def test_hash_tree(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    found = readers.hash_tree(spark, str(tmp_path))
    locked = found.withColumn("sha256", F.when(F.col("path").endswith("a.txt"), F.lit("0")).otherwise(F.col("sha256")))
    assert [r["problem"] for r in readers.differing_files(found, locked).collect()] == ["changed"]
    assert readers.tree_bytes(spark, str(tmp_path)).first()["bytes"] == 2
    assert len(readers.fingerprint(found).first()["fingerprint"]) == 64


def test_words_to_lines(spark):
    words = [("i", 1, 1, 1, 2, "World", 80.0, (60.0, 1.0, 40.0, 18.0)), ("i", 1, 1, 1, 1, "Hello", 90.0, (0.0, 0.0, 50.0, 20.0)), ("i", 1, 1, 1, 3, " ", 99.0, (0.0, 0.0, 999.0, 1.0)), ("i", 1, 1, 1, 4, "x", -1.0, (0.0, 0.0, 999.0, 1.0))]
    df = spark.createDataFrame(words, f"image_id string, block int, par int, line int, word_num int, text string, conf double, b {G.BOX}")
    (r,) = readers.word_lines(df).collect()
    assert (r["text"], r["confidence"], tuple(r["b"])) == ("Hello World", pytest.approx(0.85), (0, 0, 100, 20))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, {"b": 2, "a": 1}, [1, 2])], "i int, m map<string,int>, l array<int>")
    writers.bundle({"t": df}, str(tmp_path / "out"))
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out/t.csv")).first()
    assert spark.read.parquet(str(tmp_path / "out/t.parquet")).first()["m"] == {"a": 1, "b": 2} and "l" in row.asDict()
    writers.append_log(df, str(tmp_path / "log"))
    writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert writers.missing_outputs(spark.range(3), spark.range(1), ["id"]).count() == 2
    lines = writers.log_lines(spark.createDataFrame([(1.5,)], "detect double"), "analyze_timings")
    assert readers.stage_logs(lines).first()["fields"] == {"detect": 1.5}


# ---------------------------------------------------------------- state

DETECTED = ("detected", None, {"regions": [{"id": "a", "text": "A"}, {"id": "b", "text": "B"}]})


def state(*messages) -> R.Session:
    s = R.Session()
    for kind, region, payload in messages:
        s.apply(kind, region, payload)
    return s


def test_late_match_does_not_overwrite_the_user():
    s = state(DETECTED, ("style", "a", {"font_size": 30}), ("region", "a", {"text": "ocr", "font_size": 12, "font_weight": 700, "conf": 1}))
    a = s.regions["a"]
    assert (a["text"], a["font_size"], a["conf"], a["status"]) == ("A", 30, 1, "ready") and "font_weight" not in a


def test_waiting_edits():
    s = state(DETECTED, ("edit", "a", {"text": "mine"}))
    assert s.regions["a"]["text"] == "A"
    s.apply("region", "a", {"text": "ocr"})
    assert s.regions["a"]["text"] == "mine"
    s = state(DETECTED, ("edit", "a", {"text": "mine"}), ("error", None, {}), ("edit", "a", {"text": "again"}))
    assert s.regions["a"]["status"] == "failed" and s.rejected == 2


def test_end_without_result_fails_what_is_pending():
    s = state(DETECTED, ("region", "a", {}), ("end", None, {}))
    assert (s.regions["a"]["status"], s.regions["b"]["status"]) == ("ready", "failed")
    assert state(DETECTED, ("result", None, {"regions": [{"id": "a"}, {"id": "c"}]}), ("end", None, {})).regions["c"]["status"] == "ready"


def test_undo_and_redo():
    s = state(DETECTED, ("region", "a", {}), *[("edit", "a", {"text": str(i)}) for i in range(8)])
    for _ in range(9):
        s.apply("undo", None, {})
    assert s.regions["a"]["text"] == "2", "five steps are kept"
    s.apply("redo", None, {})
    assert s.regions["a"]["text"] == "3"
    s.apply("edit", "a", {"text": "new"})
    s.apply("redo", None, {})
    assert s.regions["a"]["text"] == "new", "an edit ends what could be redone"


def test_enrichment_order_does_not_matter():
    base = [("region", "a", {"text": "x", "font_size": 1}), ("region", "b", {"text": "y", "font_size": 2}), ("progress", None, {"current": 2})]
    ends = {json.dumps(state(DETECTED, *order).regions, sort_keys=True) for order in itertools.permutations(base)}
    assert len(ends) == 1


def rows():
    out = []
    for s in ("s1", "s2"):
        for i, (kind, region, payload) in enumerate([DETECTED, ("region", "a", {"font_size": 5}), ("edit", "b", {"text": s}), ("region", "b", {"font_size": 6}), ("undo", None, {}), ("redo", None, {})]):
            out.append((s, i, kind, region, json.dumps(payload)))
    return out


def test_stream_ends_where_replay_does(spark, tmp_path):
    df = spark.createDataFrame(rows(), R.MESSAGE)
    for lo in range(0, 6, 2):
        df.filter(f"seq >= {lo} AND seq < {lo + 2}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    want = sorted(R.replay(df.repartition(3)).collect())
    source = spark.readStream.schema(R.MESSAGE).json(str(tmp_path / "in"))
    q = R.stream(source).writeStream.format("memory").queryName("regions_out").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(set(spark.table("regions_out").collect())) == want and len(want) == 4


def test_chunks_and_fragments(spark):
    chunks = spark.createDataFrame([("s", 0, "one\ntw"), ("s", 1, "o\n\nthr"), ("s", 2, "ee")], "s string, n int, t string")
    assert [r["content"] for r in R.lines_of_chunks(chunks, ["s"], ["n"], "t").orderBy("line").collect()] == ["one", "two", "three"]
    df = spark.createDataFrame([("r", "ab|cd", 50.0), ("q", "ab|", 10.0)], "region string, text string, width double")
    got = {(r["region"], r["fragment"]): (r["content"], r["x"], r["w"]) for r in R.split_fragments(df, r"\|").collect()}
    assert got == {("r", 0): ("ab", 0.0, 20.0), ("r", 1): ("cd", 22.0, 20.0), ("q", 0): ("ab|", 0.0, 10.0)}


def test_attempts(spark):
    def outcome(*attempts):
        df = spark.createDataFrame([(list(attempts),)], "a array<struct<status:string,oom_killed:boolean>>")
        return df.select(R.attempt_outcome(F.col("a"))).first()[0]

    assert [outcome(("error", True), ("ok", False)), outcome(("error", True), ("error", True)), outcome(("error", True), ("error", False)), outcome(("timeout", None)), outcome()] == ["ok", "resource_oom", "error", "timeout", "error"]


def test_all_word_rules_in_one_pass(spark):
    """Words are shuffled once for the rules of all engines, and each gives what it gives alone."""
    from inkgrid.functions.geometry import box
    from inkgrid.sources import readers

    words = spark.range(60).selectExpr("id % 3 AS image_id", "id % 2 AS block", "0 AS par", "id % 4 AS line", "id AS word_num", "IF(id % 5 = 0, ' ', concat('w', id)) AS text", "double(id % 7 - 1) AS conf", "id AS i", "2.0D AS image_width", "3.0D AS image_height")
    words = words.withColumn("b", box(F.col("i"), F.col("i") * 2, F.lit(5), F.lit(9)))
    rules = list(readers.WORD_RULES)
    found = readers.word_lines_by(words, rules)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for rule in rules:
        one = readers.word_lines(words, rule)
        assert sorted(map(str, found.filter(F.col("rule") == rule).drop("rule").collect())) == sorted(map(str, one.collect()))
