"""Cross-fold baselines: work shared by all folds, models of the training rows alone."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakepress.operators import baselines as B
from lakepress.plans import workdir

TEXTS = ["Rain falls in the north", "the north wind falls", "wind and rain and rain", None, "", "a", "Élan in the north", "elan of the wind", "rain in the wind", "quiet north", "sun over hills", "sun over rain"]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, t, i % 3, "ab"[i % 2]) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, fold int, label string")


def _grams(text):
    words = re.findall(r"\b\w\w+\b", (text or "").lower().replace("é", "e"))
    return Counter(words + [" ".join(p) for p in zip(words, words[1:], strict=False)])


def test_vectors_of_a_fold_are_those_of_its_training_rows(rows, monkeypatch):
    monkeypatch.setattr(B, "FEATURES", 9)
    seen = {}
    monkeypatch.setattr(B, "_pipeline", lambda train, label, stages: (train, stages))
    shared, model = B.text_model(rows)
    for f in range(3):
        train, stages = model(shared.where(F.col("fold") != f), "label", f)
        assert {r.doc_id for r in train.select("doc_id").collect()} == {i for i in range(len(TEXTS)) if i % 3 != f}
        out = shared
        for s in stages:
            out = s.transform(out)
        seen[f] = {r.doc_id: r.features for r in out.select("doc_id", "features").collect()}
    for f in range(3):
        each = [_grams(t) for i, t in enumerate(TEXTS) if i % 3 != f]
        df, total = Counter(g for c in each for g in c), sum(each, Counter())
        best = sorted((g for g in df if df[g] >= B.MIN_DF), key=lambda g: (-total[g], g))[:9]
        idf = {g: math.log((1 + len(each)) / (1 + df[g])) + 1 for g in best}
        for i, t in enumerate(TEXTS):
            raw = sorted((1 + math.log(n)) * idf[g] for g, n in _grams(t).items() if g in idf)
            norm = math.sqrt(sum(w * w for w in raw)) or 1.0
            assert sorted(w for w in seen[f][i].values if w) == pytest.approx([w / norm for w in raw])


@pytest.mark.parametrize("kind", ["text", "keywords"])
def test_texts_are_read_once_for_all_folds(spark, rows, monkeypatch, kind):
    """No fold reads the texts again, for its fit or its predictions, nor do the tables written grow with the folds."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        reads.add(1)
        return text

    written = []
    monkeypatch.setattr(B, "spill", lambda df, name, schema=None: (written.append(name), workdir.spill(df, name, schema))[1])
    source = rows.withColumn("text", told.asNondeterministic()("text"))
    shared, model = B.text_model(source) if kind == "text" else B.keyword_model(source, {"A": ["rain"], "B": ["wind"]})
    got = B.cross_predict(shared, "doc_id", "fold", "label", model).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(TEXTS)))
    assert all(r.predicted in ("a", "b") for r in got)
    assert len(written) == len(set(written))
    # the filter on null texts may ask for them once more
    assert reads.value <= 2 * len(TEXTS)


def test_no_rows_give_no_predictions(rows):
    for shared, model in (B.text_model(rows.limit(0)), B.keyword_model(rows.limit(0), {"A": ["rain"]})):
        assert B.cross_predict(shared, "doc_id", "fold", "label", model).count() == 0
