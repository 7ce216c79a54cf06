from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgrid import plans
from inkgrid.functions import distance as D
from inkgrid.functions import text as X

LONG = "x" * 90 + " Quay 7"
TEXTS = {1: f"{LONG}\nsecond line\nthird é line 42!", 2: "only", 3: "", 4: "a\n\nb\n"}
LINES = {(d, k): " ".join(s.encode("ascii", "ignore").decode().split()) for d, t in TEXTS.items() for k, s in enumerate(t.split("\n"))}
PAIRS = {at: (s, LINES.get((at[0], at[1] + 1), "")) for at, s in LINES.items()}


@pytest.fixture(scope="module")
def lines_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lines")
    rows = [(d, t, "en", "s") for d, t in [*TEXTS.items(), (5, None)]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_of(spark, path, name):
    return {(r["doc_id"], r["line"]): r for r in plans.QUERIES[name](spark, path).collect() if r["doc_id"] != 5}


def test_rates_of_all_lines(spark, lines_dir):
    edits = {at: X.edit_distance(list(a), list(b)) for at, (a, b) in PAIRS.items()}
    got = rows_of(spark, lines_dir, "f06_character_distance")
    assert {at: (r["edits"], r["n"]) for at, r in got.items()} == {at: (edits[at], len(a)) for at, (a, _) in PAIRS.items()}
    total, = plans.QUERIES["a01_micro_rates"](spark, lines_dir).collect()
    chars = sum(len(a) for a in LINES.values())
    assert total["chars"] == chars and total["cer"] == round(sum(edits.values()) / chars, 6)
    words = {at: X.edit_distance(a.split(), b.split()) for at, (a, b) in PAIRS.items()}
    assert {at: r["edits"] for at, r in rows_of(spark, lines_dir, "f07_token_distance").items()} == words
    found = Counter(s[2:] for a, b in PAIRS.values() for s in X.substitutions(a, b))
    wanted = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert sorted(((r["ref_char"], r["hyp_char"]), r["count"]) for r in plans.QUERIES["f08_substitutions"](spark, lines_dir).collect()) == sorted(wanted)


def test_tokens_and_flags_of_all_lines(spark, lines_dir):
    tokens = Counter(t for a in LINES.values() for t in a.split())
    assert {r["token"]: r["n"] for r in plans.QUERIES["f12_token_multiset"](spark, lines_dir).collect()} == tokens
    counts = rows_of(spark, lines_dir, "f05_tokens")
    assert {at: (r["n_ref"], r["n_hyp"]) for at, r in counts.items()} == {at: (len(a.split()), len(b.split())) for at, (a, b) in PAIRS.items()}
    assert counts[1, 0]["numeric_tokens"] == counts[1, 2]["numeric_tokens"] == 1
    bags = rows_of(spark, lines_dir, "a20_bag_of_words")
    assert bags[1, 1]["f1"] == round(2 / 5, 6) and bags[1, 0]["numeric_total"] == 1
    mean, = plans.QUERIES["a05_macro_f1"](spark, lines_dir).filter("source = 's'").collect()
    assert mean["n"] == len(LINES) + 1
    flags = rows_of(spark, lines_dir, "f10_case_and_glyphs")
    assert flags[1, 0]["capital"] and flags[1, 0]["digit"] and flags[1, 2]["punctuation"]
    assert rows_of(spark, lines_dir, "f02_normal_form_ascii")[1, 1]["normal"] == "second line third line 42!"
    surplus = {r["token"]: (r["only_a"], r["only_b"]) for r in plans.QUERIES["j20_multiset_difference"](spark, lines_dir).collect()}
    assert surplus["Quay"] == (1, 0) and "line" not in surplus and "42!" not in surplus


def test_perturbed_lines(spark, lines_dir):
    got = rows_of(spark, lines_dir, "e08_perturbed")
    assert {at: r["ref"] for at, r in got.items()} == LINES
    inner = lambda t: sum(all(not t[j].isspace() for j in (i - 1, i, i + 1) if 0 <= j < len(t)) for i in range(len(t)))
    assert all(X.edit_distance(list(r["ref"]), list(r["read"])) == r["injected"] == min(3, inner(r["ref"])) for r in got.values())


def test_substitutions_of_a_large_table():
    """Kept a run of rows at a time, the table gives what the whole one gives."""
    rng = random.Random(4)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert X.substitutions(a, b, cells=0) == X.substitutions(a, b)


def test_substitutions_of_many_pairs_together():
    """Pairs of a batch, worked on together or alone, give the script that each gives by itself."""
    rng, kinds = random.Random(5), ["ab", "abc", "a b\u00e9\U0001d11e"]
    for size in (0, 3, 40, 150, 300):
        pairs = [tuple("".join(rng.choice(kinds[k % 3]) for _ in range(rng.randint(0, size))) for _ in range(2)) for k in range(90)]
        pair, a, b = D.substituted([x for x, _ in pairs], [y for _, y in pairs])
        found = Counter((i, chr(x), chr(y)) for i, x, y in zip(pair.tolist(), a.tolist(), b.tolist(), strict=True))
        assert found == Counter((i, *s[2:]) for i, (x, y) in enumerate(pairs) for s in X.substitutions(x, y))
        for x, y in (D._apart(*p) for p in pairs):
            if x and y:
                assert D._read_alone(x, y, kept=0) == [s[2:] for s in X.substitutions(x, y)][::-1]


def test_multisets(spark):
    rows = [["b", "a", "b", "c", "b"], [], ["x"], None]
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>")
    assert [r[0] for r in df.select(X.multiset(F.col("t"))).collect()] == [None if r is None else dict(Counter(r)) for r in rows]
