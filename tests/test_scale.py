"""Steps whose work must grow with the input and no faster."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from claimloom.operators import features as X
from claimloom.operators import grid as G
from claimloom.operators import network as N


def test_ngrams_are_linear(spark):
    """Words are found once a text, not once an n-gram."""
    words = [f"w{k % 977}" for k in range(30_000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "blue"), (3, None), (4, "")], "doc_id long, text string")
    began = time.time()
    out = {(r.doc_id, r.term): r.tf for r in X.term_counts(rows, low=2, high=3).collect()}
    assert time.time() - began < 60
    want = {}
    for n in (2, 3):
        for k in range(len(words) - n + 1):
            key = (1, " ".join(words[k : k + n]))
            want[key] = want.get(key, 0) + 1
    assert out == want


def test_few_rows_are_a_matrix():
    """Products of a network's first layer are those of a dense matrix, and quick."""
    rng = np.random.default_rng(1)
    r = np.repeat(np.arange(256), 500)
    rows = N.Sparse(256, r, rng.integers(0, 2048, len(r)), rng.normal(size=len(r)))
    dense = np.zeros((256, 2048))
    np.add.at(dense, (rows.r, rows.j), rows.v)
    w, pull = rng.normal(size=(2048, 100)), rng.normal(size=(256, 100))
    assert np.allclose(rows.times(w), dense @ w) and np.allclose(rows.transposed(pull, 2048), dense.T @ pull)
    slots = [sorted(rng.integers(0, 9, size=rng.integers(0, 30)).tolist()) for _ in range(300)] + [[]]
    batch = pa.RecordBatch.from_pydict({"slots": pa.array(slots, pa.list_(pa.int32()))})
    for at, x in N.read(batch):
        for k in range(x.n):
            found = {int(j): v for j, v in zip(x.j[x.r == k], x.v[x.r == k], strict=True)}
            want = {j: 1 + np.log(slots[at + k].count(j)) for j in set(slots[at + k])}
            norm = np.sqrt(sum(v * v for v in want.values()))
            assert found == {j: pytest.approx(v / norm) for j, v in want.items()}
    began = time.time()
    for _ in range(20):
        rows = N.Sparse(rows.n, rows.r, rows.j, rows.v)
        rows.times(w), rows.transposed(pull, 2048)
    assert time.time() - began < 8


def test_grid_prepares_without_a_row_an_ngram(spark, monkeypatch):
    """What is saved has a row a document or a feature of another block, not a row an n-gram."""
    saved = []
    real = G.written
    monkeypatch.setattr(G, "written", lambda rows: saved.append(real(rows)) or saved[-1])
    texts = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + x) % 40}" for x in range(50)), k % 2) for k in range(30)], "doc_id long, text string, label int")
    known = G.prepared(texts, {}, [G.Setting("x", ngram=3, min_df=2)])
    assert max(rows.count() for rows in saved) == 30
    df = X.term_counts(texts, high=3).groupBy("term").count().filter("count >= 2").collect()
    assert {f"{G.TERMS}:{r.term}": r["count"] for r in df} == dict(zip(known.names, known.df.sum(axis=0).astype(int).tolist(), strict=True))


def test_vocabulary_is_whole(spark):
    """No term is left out beyond 20,000."""
    rows = spark.createDataFrame([(k, " ".join(f"t{x}" for x in range(k, 20_100, 3))) for k in range(3)] + [(9, "t5 t7 t7")], "doc_id long, text string")
    got = sorted((r.id, r.term) for r in X.vocabulary(rows, most=None).collect())
    assert len(got) == 20_100 and got[:2] == [(1, "t7"), (2, "t5")] and [i for i, _ in got] == list(range(1, 20_101))
    assert X.vocabulary(rows).count() == 19_999


def test_counts_shuffle_texts_alone(spark):
    """One exchange, by document, before words are rows."""
    rows = spark.createDataFrame([(1, "aa bb aa"), (1, "aa"), (2, None)], "doc_id long, text string")
    counts = X.term_counts(rows)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, counts.collect())) == [(1, "aa", 3), (1, "bb", 1)]
    vectors = spark.createDataFrame([("aa", [3.0, None]), ("bb", [0.0, 4.0, 5.0])], "term string, vector array<float>")
    got = {(r.doc_id, r.dim): r.value for r in X.embedding_sum(rows, vectors).collect()}
    norm = np.sqrt(81 + 16 + 25)
    assert got == {(1, 0): pytest.approx(9 / norm), (1, 1): pytest.approx(4 / norm), (1, 2): pytest.approx(5 / norm)}
