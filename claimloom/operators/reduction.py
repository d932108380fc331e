"""Truncated singular value decomposition of sparse rows by randomised subspace iteration.

A round reads the rows once and sums, over all partitions, what the rows'
transpose makes of their products with a few directions: a matrix of features
by directions, whatever the number of rows.  The driver orthogonalises it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.operators.sparse import parts, products
from claimloom.operators.sums import summed


@dataclass
class Decomposition:
    values: np.ndarray  # singular values, the largest first
    vectors: np.ndarray  # (features, components); the largest entry of each is positive
    rounds: int


def decomposed(rows: DataFrame, d: int, k: int = 10, extra: int = 10, tol: float = 1e-5, rounds: int = 60, seed: int = 0) -> Decomposition:
    """SEL-09: the ``k`` largest singular values (fewer if there are fewer features) of rows (js, vs) and their right vectors.

    ``extra`` more directions are kept to part close values sooner; rounds end
    when no value moves by more than ``tol`` of itself.  Without rows or
    features all values are 0.
    """
    spark, m = rows.sparkSession, min(k + extra, d)
    k = min(k, d)
    if not d:
        return Decomposition(np.zeros(0), np.zeros((0, 0)), 0)
    count = rows.rdd.getNumPartitions()
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0]
    last, turned, took = np.zeros(k), basis[:, :k], 0
    for took in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(basis)  # features times directions

        def work(batches, shared=shared):
            q = shared.value
            out = np.zeros(q.shape)
            for _, ends, j, v in parts(batches):
                along = np.repeat(products(ends, j, v, q), np.diff(ends), axis=0) * v[:, None]
                for c in range(q.shape[1]):
                    out[:, c] += np.bincount(j, along[:, c], len(q))
            return out.ravel()

        image = summed(rows, count, work, d * m).reshape(d, m)
        shared.unpersist()
        inner = basis.T @ image
        squares, turn = np.linalg.eigh((inner + inner.T) / 2)
        values = np.sqrt(np.maximum(squares[::-1][:k], 0))
        turned = basis @ turn[:, ::-1][:, :k]
        if np.all(np.abs(values - last) <= tol * np.maximum(values, 1e-12)):
            break
        last = values
        basis = np.linalg.qr(image)[0]
    heavy = np.abs(turned).argmax(axis=0)
    return Decomposition(values, turned * np.where(turned[heavy, np.arange(k)] < 0, -1.0, 1.0), took)


def projected(rows: DataFrame, found: Decomposition) -> DataFrame:
    """(doc_id, components) of (doc_id, js, vs); a row without features is at the origin."""
    shared = rows.sparkSession.sparkContext.broadcast(found.vectors)
    k = found.vectors.shape[1]

    def run(batches):
        for few, ends, j, v in parts(batches):
            flat = products(ends, j, v, shared.value) if k else np.zeros((few.num_rows, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(few.num_rows + 1, dtype=np.int32) * k), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([few.column("doc_id"), lists], ["doc_id", "components"])

    return rows.select("doc_id", "js", "vs").mapInArrow(run, "doc_id long, components array<double>")
