"""Null texts in models and in plugged-in ones."""

from __future__ import annotations

from claimloom.operators import enrich
from claimloom.operators import models as M


def test_models_take_null_texts(spark):
    rows = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(["good true news", "fake lies", "true words here", "lies again fake", "good good", None, None, ""])], "doc_id long, text string, label int")
    model = M.fit_pipeline(rows, "svc", features=64)
    assert model.transform(rows).select("doc_id", "prediction").count() == 8
    assert {r.term for r in M.term_weights(rows, min_df=1).collect()} >= {"fake", "good"}


def test_plugged_in_model_gives_null_for_null_and_failing_texts(spark):
    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [len(t) for t in texts]

        return model

    rows = spark.createDataFrame([(1, "four"), (2, None), (3, "a bad one"), (4, ""), (5, "x")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.result for r in enrich.apply_model(rows, load, "long").collect()} == {1: 4, 2: None, 3: None, 4: 0, 5: 1}
    nothing = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in enrich.apply_model(nothing, load, "long").collect()] == [(1, None)]
