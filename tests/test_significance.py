"""p-values against closed forms, elimination against refitting."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import significance as S


def test_tails_against_closed_forms(spark):
    cases = []
    for f in (1e-9, 0.01, 0.5, 1.0, 3.7, 20.0, 400.0, 1e6):
        cases.append((f, 1, 1, 1 - 2 / math.pi * math.atan(math.sqrt(f)) if f < 10 else 2 / math.pi * math.atan(1 / math.sqrt(f))))
        cases.append((f, 1, 2, 2 / (f + 2) / (1 + math.sqrt(f / (f + 2)))))
        for d2 in (3, 10, 397, 100_000):
            cases.append((f, 2, d2, math.exp(-d2 / 2 * math.log1p(2 * f / d2))))
        cases.append((f, 4, 2, 1 - (4 * f / (4 * f + 2)) ** 2))
    rows = spark.createDataFrame([(float(f), a, b, p) for f, a, b, p in cases], "f double, a int, b int, p double")
    for r in rows.withColumn("got", S.f_tail(F.col("f"), F.col("a"), F.col("b"))).collect():
        assert abs(r.got - r.p) <= 1e-9 * max(r.p, 1e-290), r
    odd = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (float("inf"),), (0.0,)], "f double").select(S.f_tail(F.col("f"), F.lit(1), F.lit(9))).collect()
    assert [r[0] for r in odd] == [None, None, None, 0.0, 1.0]


def test_log_gamma(spark):
    for x in (0.5, 1.0, 2.5, 10.0, 199.0, 5e6):
        assert spark.range(1).select(S.log_gamma(F.lit(x))).first()[0] == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-12)


def test_percentile_with_ties(spark):
    scores = spark.createDataFrame([(f"f{k:02}", float(v) if v is not None else None) for k, v in enumerate([5, 1, 5, 5, 2, None, 3, 0, 0, 1])], "feature string, f double")
    assert sorted(r.feature for r in S.best_percentile(scores, 20).collect()) == ["f00", "f02"]
    assert sorted(r.feature for r in S.best_percentile(scores, 40).collect()) == ["f00", "f02", "f03", "f06"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(500):
        x = [rng.gauss(0, 1) for _ in range(6)]
        z = 2 * x[0] - 1.2 * x[1] + 0.6 * x[2] + 0.3 * x[3] + 0.5
        rows.append((*x, int(rng.random() < 1 / (1 + math.exp(-z)))))
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double, g double, label int").repartition(3).persist()


def test_logistic_is_at_its_optimum(planted):
    names = ["a", "b", "c"]
    weights, _ = S.logistic(planted, names)
    data = np.array([tuple(r) for r in planted.select(*names, F.lit(1.0), "label").collect()])
    x, y, w = data[:, :4], data[:, 4], np.array([weights[k] for k in [*names, "_bias"]])
    gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + np.array([1, 1, 1, 0]) * w
    assert np.abs(gradient).max() < 1e-6


def test_elimination_equals_refitting(planted):
    names = list("abcdeg")
    warm, cold = S.eliminated(planted, names, 1), S.eliminated(planted, names, 1, warm=False)
    assert [r[:2] for r in warm] == [r[:2] for r in cold]
    assert {f for f, rank, _ in warm if rank <= 4} == set("abcd") and warm[0][0] == "a"
    assert sum(s for *_, s in warm) < sum(s for *_, s in cold)
    assert [r[1] for r in S.eliminated(planted, names)] == [1, 1, 1, 2, 3, 4]
