from __future__ import annotations

from collections import defaultdict

import corpus_pipeline as P
from inkgrid.llm.common import materialize, table

from .conftest import DOCUMENTS, EXTRA


def staged(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs)
    return out


def test_stages_on_odd_rows(spark, odd_dir):
    source = table(spark, odd_dir, "documents")
    outs = staged(spark, odd_dir)
    for df in outs[:-1]:
        assert df.columns == source.columns and set(EXTRA) < set(df.columns)
    clean, distinct, cut, packed = outs
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} >= {1, 2, 3, 4, 5, None}
    kept = [r["doc_id"] for r in distinct.select("doc_id").collect()]
    assert kept.count(1) == 1 and 5 not in kept and 14 not in kept and kept.count(6) == 2 and kept.count(None) == 2 and {1, 2, 3, 4, 10} <= set(kept)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.filter("doc_id IS NOT NULL").collect()}
    assert texts[2] == (None, None) and texts[3] == ("", 0)
    before = dict(DOCUMENTS)
    assert texts[1][0] == before[1] and all(n == len(t) for t, n in texts.values() if t is not None)
    sums, want = defaultdict(int), {}
    for r in packed.collect():
        sums[r["doc_id"]] += r["length"]
        want[r["doc_id"]] = r["doc_tokens"]
    assert set(sums) == set(kept) and all(sums[d] == want[d] for d in sums if kept.count(d) == 1)


def test_run_equals_the_stages(spark, odd_dir):
    digest = lambda df: sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    by_document = lambda rows: sorted({(d, n) for d, *_ in rows for n in [sum(x[2] for x in rows if x[0] == d)]})
    assert by_document(digest(P.run(spark, odd_dir))) == by_document(digest(staged(spark, odd_dir)[-1]))


def test_empty_tables(spark, empty_dir):
    assert P.run(spark, empty_dir).count() == 0
