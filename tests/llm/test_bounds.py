from __future__ import annotations

import glob

import numpy as np

from inkgrid.llm import components, toxicity
from inkgrid.llm.common import materialize, shared_dir


def test_the_classifier_holds_its_bound_on_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"word{w}" for w in rng.integers(0, 60, 40)) + (" hateful slur" if i % 3 == 0 else " kind note"), int(i % 3 == 0)) for i in range(300)]
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen, train = [], toxicity.train_logistic

    def spy(columns, offsets, *rest, **named):
        seen.append((len(columns), np.count_nonzero(np.diff(offsets))))
        return train(columns, offsets, *rest, **named)

    monkeypatch.setattr(toxicity, "train_logistic", spy)
    toxicity.fit(documents, labels)
    model = toxicity.fit(documents, labels, max_pairs=400)
    assert seen[0][0] > 400 >= seen[1][0] and seen[1][1] < seen[0][1]
    score = model.scorer()([" a hateful slur ", " a kind note "])
    assert score[0] > 0.5 > score[1]


def test_rounds_of_components_leave_one_table(spark):
    def tables():
        return set(glob.glob(shared_dir(spark).removeprefix("file:") + "/inkgrid/bounds-*"))

    edges = materialize(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long"), "chain")
    before = tables()
    got = {r["node"]: r["root"] for r in components.components(edges, "bounds").collect()}
    assert len(tables() - before) == 1
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert edges.count() == 41
