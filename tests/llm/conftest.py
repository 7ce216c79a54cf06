from __future__ import annotations

import random

import pytest

VOCABULARY = [a + b for a in ("ba", "co", "di", "fu", "ge", "ha") for b in ("n", "rt", "s", "lle", "m", "no", "pp", "qua")]


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE = sentence(99, 60)
LONG = sentence(7, 60_000)
#: Nulls everywhere, empty and very long texts, repeated rows, a repeated id, ties, odd characters.
DOCUMENTS = [
    (1, sentence(1, 80)),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, sentence(1, 80)),
    (5, sentence(1, 80)),
    (6, sentence(2, 40) + " " + PASSAGE + " " + sentence(3, 40)),
    (6, sentence(4, 30)),
    (None, sentence(5, 30)),
    (None, None),
    (8, "é日😀 ﬁ İstanbul ΑΣ ▁ x"),
    (9, "\t\x01 odd\x0b characters  <|endoftext|>\r\n\n  "),
    (10, "!!! ... ???"),
    (11, PASSAGE + " " + sentence(6, 50)),
    (12, "word"),
    (13, "Released under the MIT License.\nand you are an idiot moron"),
    (14, " ".join(sentence(1, 80).split()[:-1] + ["changed"])),
]
#: Further columns with names that the operators use themselves.
EXTRA = ["score", "key", "row", "n", "doc", "marks", "_text", "_doc", "class_id", "_lower", "ids", "part"]


def write_tables(spark, path, documents, labels, vectors) -> str:
    extra = ", ".join(f"`{c}` string" for c in EXTRA)
    rows = [(d, t, None, None, None if t is None else len(t), *(["x"] * len(EXTRA))) for d, t in documents]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, score string, list int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


LABELS = [(d, None, y, "x") for d, y in [(1, 0), (4, 0), (5, 0), (6, 0), (11, 0), (13, 1), (13, 1), (8, None), (9, 7), (12, 0), (12, 1), (None, 1), (404, 1)]]
VECTORS = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [None, 1.0]), (120, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [-1.0, 0.0]), (9, [float("inf"), 0.0])]


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("odd") / "t", DOCUMENTS, LABELS, [(i, v, 1, "x", 1) for i, v in VECTORS])


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty") / "t", [], [], [])
