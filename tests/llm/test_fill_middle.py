from __future__ import annotations

import hashlib
import random

import pytest

from inkgrid.llm.fill_middle import fill_in_middle, op12_duckdb_fill_in_middle

from .conftest import DOCUMENTS, EXTRA, sentence


def plainly(doc_id, text, seed=1, plain_from=90, spm_below=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}"


def odd_texts(n: int) -> list[str]:
    rng = random.Random(4)
    parts = ["a", "é", "日", "😀", "\n", "\r\n", "<", "<P", "S>", "M>", ">", "<P>", "\x00", "́", " ", "'", "\\", "{1,32}", "xyz" * 11]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(n)]
    return texts + ["😀" * k for k in (1, 31, 32, 33, 63, 64, 65)] + ["<" * 64, "<S" * 40, "", "x", sentence(8, 30_000)]


@pytest.mark.parametrize("settings", [{}, {"seed": 7, "plain_from": 100, "spm_below": 50}, {"plain_from": 0}])
def test_equals_a_plain_loop(spark, settings):
    rows = list(enumerate(odd_texts(400)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fill_in_middle(docs, **settings).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r, want = got[i], plainly(i, text, **settings)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want, (i, text[:50])
        assert r["restored"] == text
        assert r["output_sha256"] == hashlib.sha256(want[4].encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_query_on_odd_documents(spark, odd_dir):
    want = []
    for i, text in DOCUMENTS:
        n, form, a, m, output = plainly(i, text)
        want.append((i, n, form, a, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, op12_duckdb_fill_in_middle(spark, odd_dir).collect()))) == sorted(map(repr, want))


def test_query_on_an_empty_table(spark, empty_dir):
    assert op12_duckdb_fill_in_middle(spark, empty_dir).collect() == []


def test_columns_are_kept(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    rows = fill_in_middle(docs, keep=["text", "n_chars", *[c for c in EXTRA if c != "n"]]).collect()
    assert all(r["restored"] == (r["text"] or "") and r["score"] == "x" for r in rows) and len(rows) == len(DOCUMENTS)
    with pytest.raises(ValueError):
        fill_in_middle(docs, keep=["N"])
