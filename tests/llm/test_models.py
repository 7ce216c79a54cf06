from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import license_scan, masked_lm, toxicity, vector_search, winnow

from .conftest import DOCUMENTS, PASSAGE, VECTORS, sentence

# ---------------------------------------------------------------- toxicity


def labelled(spark, n: int = 300):
    rows = [(i, sentence(i, 60) + (f" you {['idiot', 'moron'][i % 2]} there " if i % 5 == 0 else " ") + sentence(-i, 60)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(n)], "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    documents, labels = labelled(spark)
    scored = toxicity.with_scores(documents, labels, ["doc_id"]).withColumn("out", toxicity.held_out()).collect()
    out = [r for r in scored if r["out"]]
    assert len(out) > 30 and all((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in out)


def test_features_are_distinct_grams_within_one_text():
    rows, buckets = toxicity.present(["abc", "", "abcabc"])
    assert set(rows.tolist()) == {0, 1, 2} or set(rows.tolist()) == {0, 2}
    alone = toxicity.present(["abc"])[1].tolist()
    assert buckets[rows == 0].tolist() == alone and set(alone) & set(buckets[rows == 2].tolist())


def test_scores_of_odd_rows(spark, odd_dir, empty_dir):
    got = toxicity.op7_nb_ngram_toxicity(spark, odd_dir).collect()
    assert len(got) == len(DOCUMENTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1, "null text is empty text"
    assert toxicity.op7_nb_ngram_toxicity(spark, empty_dir).count() == 0


def test_labels_of_one_class(spark):
    documents, _ = labelled(spark, 10)
    only = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.with_scores(documents, only, ["doc_id"]).collect()} == {1.0}


# ---------------------------------------------------------------- language model


def test_probabilities_sum_to_one():
    net = masked_lm.Network(64)
    context = np.random.default_rng(0).integers(0, 65, (5, 4))
    total = sum(np.exp(net.log_probability(context, np.full(5, t))) for t in range(64))
    assert total == pytest.approx(np.ones(5), abs=1e-5)


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(0)
    target = rng.integers(0, 64, 500)
    context = np.stack([target, (target + 1) % 64, target, rng.integers(0, 64, 500)], axis=1)
    net = masked_lm.Network(64)
    memory, before = np.full_like(net.weights, 1e-4), net.log_probability(context, target).mean()
    for _ in range(100):
        net.step(context, target, memory, 0.3)
    assert net.log_probability(context, target).mean() > before + 1


def test_gradients_equal_differences():
    """The step direction against numeric differences of the loss."""
    net, rng = masked_lm.Network(32, dims=2, hidden=3), np.random.default_rng(1)
    context, target = rng.integers(0, 33, (20, 4)), rng.integers(0, 32, 20)
    start = net.weights.astype(np.float64)

    def loss(w):
        return -masked_lm.Network(32, 2, 3, w.astype(np.float64)).log_probability(context, target).mean()

    memory = np.full(len(start), 1e12)
    moved = masked_lm.Network(32, 2, 3, start.copy())
    moved.step(context, target, memory, 1e6)  # so large a memory makes the step the plain gradient
    gradient = start - moved.weights
    for i in rng.choice(len(start), 25, replace=False):
        d = np.zeros(len(start))
        d[i] = 1e-5
        assert gradient[i] == pytest.approx((loss(start + d) - loss(start - d)) / 2e-5, abs=1e-5)


def test_natural_order_scores_higher(spark):
    rng = np.random.default_rng(3)
    cycle = " ".join(f"w{i % 12}" for i in range(120))
    rows = [(i, cycle) for i in range(60)] + [(100 + i, " ".join(rng.permutation(cycle.split()))) for i in range(3)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scored = {r["doc_id"]: r["mean_score"] for r in masked_lm.score_documents(documents, masked_lm.fit(documents, size=64, hashed=16, rounds=3, batch_size=64), ["doc_id"]).collect()}
    assert min(scored[i] for i in range(60)) > max(scored[100 + i] for i in range(3)) + 0.5


def test_scores_are_summed_conditional_log_probabilities(spark):
    """Every score against a plain loop over the words of a text; probabilities of all words of the corpus sum to one; the
    number of partitions changes nothing."""
    rng = np.random.default_rng(12)
    names = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(names, 30, p=np.arange(60, 0, -1) / 1830))) for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    how = dict(size=32, hashed=8, rounds=2, batch_size=128)
    runs = []
    for n in (1, 8):
        own = documents.repartition(n)
        model = masked_lm.fit(own, **how)
        runs.append({r["doc_id"]: r["score"] for r in masked_lm.score_documents(own, model, ["doc_id"]).collect()})
    assert runs[0] == pytest.approx(runs[1], rel=1e-6), "but for the rounding of single precision"
    counts = Counter(w for _, t in rows for w in t.split())
    number = {}
    for w in counts:
        hashes, _ = masked_lm.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))
        number[w] = int(model.vocabulary.lookup(hashes)[0])
    entries = Counter()
    for w, n in counts.items():
        entries[number[w]] += n
    assert len(model.vocabulary.hashes) == 24 and sum(i >= 24 for i in number.values()) == len(counts) - 24
    net = masked_lm.Network(32, weights=model.weights)

    def log_p(word, around):
        return float(net.log_probability(np.array([around]), np.array([number[word]]))[0]) + np.log(counts[word] / entries[number[word]])

    for d, text in rows[:10]:
        ids = [32, 32, *(number[w] for w in text.split()), 32, 32]
        want = sum(log_p(w, [ids[k], ids[k + 1], ids[k + 3], ids[k + 4]]) for k, w in enumerate(text.split()))
        assert runs[0][d] == pytest.approx(want, rel=1e-5)
    used = {number[w] for w in counts}
    unused = sum(np.exp(net.log_probability(np.array([[1, 2, 3, 4]]), np.array([i])))[0] for i in range(32) if i not in used)
    assert sum(np.exp(log_p(w, [1, 2, 3, 4])) for w in counts) + unused == pytest.approx(1, abs=1e-5)


def test_language_scores_of_odd_rows(spark, odd_dir, empty_dir):
    got = masked_lm.op4_masked_pseudo_likelihood(spark, odd_dir).collect()
    assert len(got) == len(DOCUMENTS)
    for r in got:
        if r["doc_id"] in (2, 3, 10):
            assert (r["n_tokens"], r["score"], r["mean_score"]) == (0, 0.0, None)
        elif r["n_tokens"]:
            assert r["score"] < 0 and np.isfinite(r["score"])
    assert masked_lm.op4_masked_pseudo_likelihood(spark, empty_dir).count() == 0


# ---------------------------------------------------------------- vectors


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[20] *= 4
    x[700:760] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in vector_search.search(df, F.col("vec_id") % 20 == 0, k=10, chunk=100, sample=500).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:10]
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert all(score == pytest.approx(s[v], rel=1e-12) for _, v, score in rows)
        assert [(-score, v) for _, v, score in rows] == sorted((-score, v) for _, v, score in rows)
        hits += len(set(best) & {v for _, v, _ in rows})
    assert hits / (75 * 10) >= 0.9
    assert [v for _, v, _ in sorted(got[20])] == [v for v in range(700, 710)], "ties go to the smaller id"


def test_only_the_scan_answers(spark, monkeypatch):
    """What the scan does not find is not returned, and it alone finds most with a sample far below the table."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    x = (centres[rng.integers(0, 12, 2000)] + 0.4 * rng.standard_normal((2000, 24))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = {q: set() for q in range(0, 2000, 20)}
    for r in vector_search.search(df, F.col("vec_id") % 20 == 0, k=10, chunk=100, sample=100).collect():
        hits[r["query_id"]].add(r["vec_id"])
    found = 0
    for q, got in hits.items():
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got) == 10
        found += len(got & set(np.argsort(-s)[:10].tolist()))
    assert found / 1000 >= 0.9
    monkeypatch.setattr(vector_search, "scan", lambda blocks, index: spark.createDataFrame([], "query_id long, vec_id long, score double"))
    assert vector_search.search(df, F.col("vec_id") % 20 == 0, k=10, sample=100).count() == 0


def test_search_of_odd_rows(spark, odd_dir, empty_dir):
    got = vector_search.op3_adaptive_dimension_scan(spark, odd_dir).collect()
    good = {i: v for i, v in VECTORS if i is not None and v and len(v) == 2 and None not in v and any(v) and all(np.isfinite(v))}
    assert {r["query_id"] for r in got} == {0, 20}
    for q in (0, 20):
        want = sorted((-float(np.dot(good[q], v)), i) for i, v in good.items() if i != q)
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert vector_search.op3_adaptive_dimension_scan(spark, empty_dir).count() == 0


# ---------------------------------------------------------------- fingerprints


def brute_winnow(text: str, k: int, w: int) -> list[int]:
    """Chosen positions by the definition, from the operator's own hashes of single grams."""
    b = text.encode()
    if len(b) < k:
        return [0] if b else []
    grams = [winnow.winnow(pa.array([b[i : i + k].decode("latin-1")]), k, w) for i in range(len(b) - k + 1)] if b.isascii() else None
    values = [int(g[0][0][0]) for g in grams]
    n, chosen = len(values), []
    for lo in range(max(1, n - w + 1)):
        window = values[lo : lo + w]
        at = lo + max(i for i, v in enumerate(window) if v == min(window))
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return chosen


def test_winnowing_by_definition():
    for text in [sentence(1, 60), "a" * 80, "abab" * 30, sentence(2, 5), "short", ""]:
        (_, positions), = winnow.winnow(pa.array([text]), 8, 12)
        assert positions.tolist() == brute_winnow(text, 8, 12)


def test_match_guarantee():
    """A common run of w + k - 1 bytes leaves a common fingerprint."""
    shared = PASSAGE[: winnow.GRAM + winnow.WINDOW - 1]
    (a, _), (b, _) = winnow.winnow(pa.array([sentence(11, 90) + shared + sentence(12, 90), sentence(13, 30) + shared + sentence(14, 70)]))
    assert set(a.tolist()) & set(b.tolist())


def test_fingerprints_of_odd_rows(spark, odd_dir, empty_dir):
    got = winnow.op5_winnowing(spark, odd_dir).collect()
    assert len(got) == len(DOCUMENTS)
    order = sorted(((d is not None, d or 0, t or "") for d, t in DOCUMENTS), key=lambda r: r[:2], reverse=True)
    unique = [r for r in order if sum(o[:2] == r[:2] for o in order) == 1]
    for known, d, text in unique:
        row = next(r for r in got if r["doc_id"] == (d if known else None))
        i = order.index((known, d, text))
        options = [o[2] for o in order if o[:2] == order[(i + 1) % len(order)][:2]]
        assert row["edited_sha256"] in {hashlib.sha256(winnow.edited(text, nxt).encode()).hexdigest() for nxt in options}
        assert row["n_chars"] == len(text) and 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    same = {r["fingerprint"] for r in got if r["doc_id"] in (1, 5)}
    assert len(same) == 1
    hashes, positions = winnow.from_string(same.pop())
    assert len(hashes) == len(positions) > 0
    assert winnow.op5_winnowing(spark, empty_dir).count() == 0


# ---------------------------------------------------------------- licences


def test_license_scan(spark, odd_dir, empty_dir):
    rows = [(1, "some more words stand before it in this text\nLicensed under the APACHE license, version 2.0!\nand many more of them follow after it"), (2, license_scan.PARAGRAPHS["MIT"][0].replace(", ", ",\n")), (3, None), (4, ""), (5, "a license of no kind")]
    got = {r["doc_id"]: (r["licenses"], r["n_matches"]) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {1: ("Apache-2.0", 1), 2: ("MIT", 1), 3: ("", 0), 4: ("", 0), 5: ("", 0)}
    found = {r["doc_id"]: r["licenses"] for r in license_scan.op8_license_scan(spark, odd_dir).collect()}
    assert found[13] == "MIT" and found[2] == ""
    assert license_scan.op8_license_scan(spark, odd_dir).count() == len(DOCUMENTS)
    assert license_scan.op8_license_scan(spark, empty_dir).count() == 0


def test_each_template_names_its_own_license(spark):
    """Notices with other punctuation, headers over several lines and the paragraphs of full texts."""
    rows, want = [], {}
    for name, texts in license_scan.TEMPLATES.items():
        for text in texts:
            rows.append((len(rows), text.upper().replace(". ", ".\n# ")))
            want[len(rows) - 1] = name
    notices = ["This project is licensed under the MIT License", "Licensed under the ISC License", "// SPDX-License-Identifier: GPL-2.0-only", "# SPDX-License-Identifier: BSD-3-Clause"]
    for text, name in zip(notices, ["MIT", "ISC", "GPL-2.0", "BSD-3-Clause"], strict=True):
        rows.append((len(rows), text))
        want[len(rows) - 1] = name
    full = "\n\n".join([license_scan.PARAGRAPHS["BSD"][0], *license_scan.PARAGRAPHS["BSD"][1:3], license_scan.PARAGRAPHS["BSD-3-Clause"][1], license_scan.PARAGRAPHS["BSD"][3]])
    rows.append((len(rows), full))
    want[len(rows) - 1] = "BSD|BSD-3-Clause"
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("x"))
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(df, ["doc_id", "found"]).collect()}
    assert {d: n for d, n in got.items() if want[d] not in n.split("|") and n != want[d]} == {}


def test_no_match_lacks_every_marking_word():
    """Of each template, take out all bigrams with a marking word: what is left does not reach the threshold, whatever the rest."""
    known = license_scan.prepared()
    marks = set(license_scan.marking_words(known, 0.8))
    assert len(marks) < 40
    for _, _, _, own in known:
        rest = [g for g in own if not marks & set(g.split())]
        assert 2 * len(rest) / (len(rest) + len(own)) < 0.8


def test_license_bounds_lose_nothing():
    for _, least, most, own in license_scan.prepared():
        n = len(own)
        assert 2 * (least - 1) / (least - 1 + n) < 0.8 <= 2 * least / (least + n)
        assert 2 * n / (most + n) >= 0.8 > 2 * n / (most + 1 + n)


def test_licenses_as_people_write_them(spark):
    """Any line end, comment marks, paragraphs run together, and a notice among other sentences of its line."""
    mit = license_scan.PARAGRAPHS["MIT"]
    whole = "\n\n".join(p.replace(", ", ",\n") for p in mit)
    texts = {
        "unix": whole, "dos": whole.replace("\n", "\r\n"), "mac": whole.replace("\n", "\r"), "shell": "\n".join("# " + x for x in whole.split("\n")), "c": "\n".join(" * " + x for x in whole.split("\n")), "sql": "\n".join("-- " + x for x in whole.split("\n")),
        "together": " ".join(mit), "wrapped": " ".join(mit).replace(", ", ",\n"), "sentence": "Copyright (c) 2021 Jane Doe. Licensed under the MIT License. All rights reserved by nobody at all here.",
        "plain": "A sentence about a license. Another one. And a third, of no kind whatever.",
    }
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), ["doc_id"]).collect()}
    assert {k: r["licenses"] for k, r in found.items()} == {k: "" if k == "plain" else "MIT" for k in texts}
    assert len({found[k]["n_matches"] for k in ("unix", "dos", "mac", "shell", "c", "sql")}) == 1


def test_notices_are_found_at_every_place(spark, odd_dir, empty_dir):
    """in the middle of a longer sentence, over line ends, in lines without "licen", at both ends of a very long text."""
    gpl, apache = license_scan.PARAGRAPHS["GPL-2.0"][0], license_scan.PARAGRAPHS["Apache-2.0"][2]
    stuff = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"{stuff} released under the mit license {stuff}"), (2, f"{stuff} {apache} {stuff}"), (3, f"{stuff} Licensed\nunder the\nISC\n\nLicense {stuff}"), (4, f"{stuff} {gpl} {stuff}"), (5, None), (6, "under"), (7, f"Licensed under the zlib License {stuff * 1000} released under the unlicense"), (8, f"the license of {stuff} and the license under which")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["windows"] for r in license_scan.scan_license_windows(df, ["doc_id"]).collect()}
    assert {k: "|".join(sorted({m["name"] for m in v})) for k, v in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: "ISC", 4: "GPL-2.0", 5: "", 6: "", 7: "Unlicense|Zlib", 8: ""}
    assert max(m["score"] for m in got[4]) == max(m["score"] for m in got[2]) == 1.0 and {m["start"] for m in got[1]} >= {60}
    by_segment = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(df, ["doc_id"]).collect()}
    assert not any(by_segment[k] for k in (1, 2, 3, 4))
    assert {r["doc_id"]: r["licenses"] for r in license_scan.license_windows(spark, odd_dir).collect()}[13] == "MIT"
    assert license_scan.license_windows(spark, odd_dir).count() == len(DOCUMENTS) and license_scan.license_windows(spark, empty_dir).count() == 0


def test_license_windows_equal_all_runs(spark):
    """Against every run of words of every length, with repeats; a run that begins elsewhere is never better."""
    rng = random.Random(8)
    templates = {"it's": ["alpha beta gamma delta epsilon zeta"], "B": ["alpha beta gamma theta epsilon zeta eta alpha beta kappa", "gamma delta lambda"]}
    words = "alpha beta gamma delta epsilon zeta eta theta kappa lambda x y".split()
    texts = [" ".join(w if rng.random() < 0.8 else rng.choice(words) for w in (templates[rng.choice(list(templates))][0] + " " + rng.choice(words)).split() * 2) for _ in range(60)]
    known = license_scan.prepared(0.7, templates)
    got = {r["text"]: [(m["start"], round(m["score"], 9), m["name"]) for m in r["windows"]] for r in license_scan.scan_license_windows(spark.createDataFrame([(t,) for t in texts], "text string"), ["text"], 0.7, templates).collect()}
    for t in texts:
        w = t.split()
        pairs = [f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)]
        best, anywhere = {}, 0.0
        for k, (name, _, most, own) in enumerate(known):
            for i in range(len(pairs)):
                score = max(2 * len(set(own) & set(pairs[i:j])) / (len(own) + len(set(pairs[i:j]))) for j in range(i + 1, min(i + most, len(pairs)) + 1))
                anywhere = max(anywhere, score)
                if pairs[i] in own and score >= 0.7:
                    best[i] = max(best.get(i, (0, 0, "")), (round(score, 9), -k, name))
        assert got[t] == [(i, s, n) for i, (s, _, n) in sorted(best.items())]
        assert max((s for _, s, _ in got[t]), default=0.0) == (round(anywhere, 9) if anywhere >= 0.7 else 0.0)


def test_low_thresholds_leave_no_segment_out(spark):
    """a segment of any size that reaches a low threshold is compared; scores as by brute force over the lines."""
    templates = {"one": ["alpha beta gamma"], "two": ["beta gamma delta epsilon zeta"]}
    line = lambda k, n: " ".join(["alpha beta gamma"[: 5 * k], *[f"w{i}" for i in range(n)]]) + " beta gamma"
    texts = [line(k, n) for k in range(4) for n in (0, 3, 12, 21, 24, 25, 40, 70)]
    grams = {name: set(license_scan.bigrams(own[0])) for name, own in templates.items()}
    for threshold in (0.05, 0.14, 0.3, 0.8):
        rows = license_scan.scan_licenses(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), ["doc_id"], threshold, templates).collect()
        for r in rows:
            own = set(license_scan.bigrams(texts[r["doc_id"]]))
            best = max(2 * len(own & g) / (len(own) + len(g)) for g in grams.values())
            assert r["best_score"] == (best if best >= threshold else None), (threshold, texts[r["doc_id"]])
