"""Nearest neighbours against looking at every vector."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import neighbours as K


def brute(points, queries, k):
    out = {}
    for q in queries:
        d = sorted((round(float(((np.array(v) - points[q]) ** 2).sum()), 9), i) for i, v in points.items() if i != q)
        out[q] = [i for _, i in d[:k]]
    return out


def ours(spark, rows, k, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = K.nearest(df, F.col("vec_id") % 7 == 0, k, **kw).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out, {r.query_id: r.blocks_met for r in found}


@pytest.mark.parametrize("block", [20_000, 9])
def test_clusters_and_skipped_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 30, (12, 5))
    points = {i: centres[i % 12] + rng.normal(size=5) for i in range(300)}
    points |= {1000 + i: points[14].copy() for i in range(30)}  # copies of a query
    got, met = ours(spark, [(i, v.tolist()) for i, v in points.items()], 10)
    assert got == brute(points, got, 10) and len(got) == sum(i % 7 == 0 for i in points)
    assert np.mean(list(met.values())) < 16  # of up to 32 blocks


def test_awkward_vectors_and_few_of_them(spark):
    rows = [(0, [1.0, 2.0]), (7, [1.0, 2.0]), (3, [0.0, 0.0]), (14, None), (21, [1.0]), (28, [float("nan"), 1.0]), (35, [None, 1.0]), (42, [float("inf"), 0.0]), (49, [])]
    got, _ = ours(spark, rows, 10)
    assert got == {0: [7, 3], 7: [0, 3]}
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert K.nearest(none, F.col("vec_id") % 7 == 0).count() == 0


def test_majority(spark):
    near = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 13), (2, 14)], "query_id long, vec_id long")
    labels = spark.createDataFrame([(10, 3), (11, 3), (12, 2), (13, 2), (14, None)], "vec_id long, label int")
    assert [tuple(r) for r in K.voted(near, labels).collect()] == [(1, 2)]
