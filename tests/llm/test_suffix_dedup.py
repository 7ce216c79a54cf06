from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from inkgrid.llm import suffix_dedup as S

from .conftest import DOCUMENTS, LONG, PASSAGE, sentence


def brute(rows: list[tuple[int, str]], least: int) -> dict[int, tuple]:
    seen, out = set(), {}
    for d, text in sorted(rows):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            if w in seen:
                gone[p : p + least] = True
            seen.add(w)
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def corpus(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 200))) for _ in range(6)]
    rows = []
    for d in range(40):
        parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 80))) if rng.random() < 0.5 else rng.choice(passages)[: rng.randint(1, 200)] for _ in range(rng.randint(0, 6))]
        rows.append((d * 7 % 40, "".join(parts)))
    return rows + [(50, "ab" * 200), (51, "a" * 300), (52, rows[0][1]), (53, "xyz")]


@pytest.mark.parametrize(("seed", "crowd"), [(0, 4096), (1, 4096), (2, 1)])
def test_equals_brute_force(spark, seed, crowd):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df, ["doc_id"], least=40, gram=12, crowd=crowd).collect()}
    assert got == brute(rows, 40)


def test_interval_tree():
    """Values, bounds and parents of nested intervals."""
    tree = S.interval_tree(np.array([0, 5, 5, 8, 0, 3, 9, 6]), 3)
    spans = {(v, a, b): p for v, a, b, p in tree.tolist()}
    rows = [tuple(t[:3]) for t in tree.tolist()]
    assert set(spans) == {(5, 0, 3), (8, 2, 3), (3, 4, 7), (6, 5, 7), (9, 5, 6)}
    parent = {k: rows[p] if p >= 0 else None for k, p in spans.items()}
    assert parent == {(5, 0, 3): None, (8, 2, 3): (5, 0, 3), (3, 4, 7): None, (6, 5, 7): (3, 4, 7), (9, 5, 6): (6, 5, 7)}


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(3)
    for _ in range(25):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(3)]
        places: dict[bytes, list] = {}
        for t, text in enumerate(texts):
            for i in range(len(text)):
                for j in range(i + 3, len(text) + 1):
                    places.setdefault(text[i:j], []).append((t, i))
        want = set()
        for w, at in places.items():
            before = [texts[t][i - 1] if i else None for t, i in at]
            after = [texts[t][i + len(w)] if i + len(w) < len(texts[t]) else None for t, i in at]
            diverse = lambda x: len(set(x)) > 1 or None in x
            if len(at) > 1 and diverse(before) and diverse(after):
                want.add((len(w), tuple(sorted(at))))
        assert {(n, tuple(at)) for n, at in S.maximal_repeats(texts, 3)} == want


def closures(rows: list[tuple[int, str]], least: int) -> set:
    """(length, all occurrences) of the greatest string around each repeated window that stands wherever it stands."""
    texts = {d: t.encode() for d, t in rows}
    places: dict[bytes, list] = {}
    for d, b in sorted(texts.items()):
        for p in range(len(b) - least + 1):
            places.setdefault(b[p : p + least], []).append((d, p))
    out = set()
    for at in places.values():
        if len(at) > 1:
            left, right = 0, least
            while len({texts[d][p - left - 1] if p > left else -1 - i for i, (d, p) in enumerate(at)}) == 1:
                left += 1
            while len({texts[d][p + right] if p + right < len(texts[d]) else -1 - i for i, (d, p) in enumerate(at)}) == 1:
                right += 1
            out.add((left + right, tuple((d, p - left) for d, p in at)))
    return out


def groups(spark, rows, **how) -> set:
    found: dict[tuple, list] = {}
    for r in S.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **how).collect():
        found.setdefault((r["grp_doc"], r["grp_lo"], r["length"]), []).append((r["doc"], r["lo"]))
    assert all(k[:2] == min(v) for k, v in found.items())
    return {(k[2], tuple(sorted(v))) for k, v in found.items()}


@pytest.mark.parametrize(("seed", "crowd"), [(0, 4096), (1, 4096), (1, 1)])
def test_groups_equal_brute_force(spark, seed, crowd):
    rows = corpus(seed)
    assert groups(spark, rows, least=40, gram=12, crowd=crowd) == closures(rows, 40)


def test_a_long_passage_is_one_group(spark):
    """700 bytes in five documents, two of them equal: one group with all places, one more for the equal documents."""
    passage = sentence(31, 200)[:700]
    texts = [f"{sentence(i, 40)} {passage} {sentence(50 + i, 40)}" for i in range(4)]
    rows = [*enumerate(texts), (4, texts[2])]
    got = groups(spark, rows)
    (whole,) = [g for g in got if len(g[1]) == 5]
    assert 700 <= whole[0] <= 704 and {d for d, _ in whole[1]} == {0, 1, 2, 3, 4}
    assert got == closures(rows, 100) and (len(texts[2]), ((2, 0), (4, 0))) in got


def test_repeated_rows_without_an_earlier_twin_stay(spark):
    text, other = sentence(21, 90), sentence(22, 90)
    rows = [(5, text), (5, text), (None, other), (None, other), (7, sentence(23, 90))]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], with_text=True).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept"]) for r in got) == sorted((str(d), 0, t) for d, t in rows)


def test_carried_columns_come_back(spark):
    names = ["doc", "text", "marks", "row", "_doc", "_id", "_text", "key", "n_bytes", "a b"]
    rows = [(i, sentence(3, 80), *("x" * len(names[2:])), "y") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names if c != "text"))
    got = S.remove_repeats(df, ["doc_id", *names])
    assert got.columns == ["doc_id", *[c for c in names if c != "n_bytes"], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for r in got.collect():
        assert r["doc"] == r["_doc"] == r["marks"] == "x" and r["text"] == sentence(3, 80) and (r["n_removed"] > 0) == (r["doc_id"] > 0)


def test_odd_rows(spark, odd_dir, empty_dir):
    got = S.op6_suffix_dedup(spark, odd_dir).collect()
    assert len(got) == len(DOCUMENTS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"]))
    assert by[2] == by[3] == [(0, 0, 0)] and by[4][0][0] == len(LONG.encode())
    n = len(DOCUMENTS[0][1].encode())
    assert by[1] == [(n, 0, 0)] and by[5] == [(n, n, 1)] * 2, "an equal row counts once, and both give way to the earlier document"
    assert by[11][0][1] >= len(PASSAGE), "the passage stands earlier too"
    assert S.op6_suffix_dedup(spark, empty_dir).count() == 0
