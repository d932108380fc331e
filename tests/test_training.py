"""Settings trained together against one at a time; gradients against differences; held-out scores."""

from __future__ import annotations

import random

import numpy as np
import pytest

from claimloom.operators import grid as G
from claimloom.operators import network as N


@pytest.fixture(scope="module")
def articles(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        label = int(rng.random() < 0.4)
        text = rng.choices(words, k=rng.randint(5, 40)) + rng.choices(["bad", "fake", "lie"] if label else ["good", "true"], k=3)
        rng.shuffle(text)
        rows.append((k, " ".join(text), label))
    rows += [(900, None, 0), (901, "", 1), (902, "no label here", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3).persist()


SETTINGS = [
    G.Setting("a", ngram=1, min_df=2, penalty="l2", tol=1e-3),
    G.Setting("b", ngram=2, min_df=3, penalty="l1", tol=1e-2),
    G.Setting("c", ((G.TERMS, 0.2), ("extra", 0.2), ("nobody", 0.2)), ngram=2, min_df=3),
    G.Setting("d", (("nobody", 1.0),)),
]


def extra(articles):
    return {"extra": articles.selectExpr("doc_id", "'n' AS feature", "cast(length(text) AS double) AS value").filter("value IS NOT NULL")}


def test_together_is_as_alone(articles, monkeypatch):
    known = G.prepared(articles, extra(articles), SETTINGS)
    passes = []
    real = G.summed
    monkeypatch.setattr(G, "summed", lambda *a: passes.append(1) or real(*a))
    weights, steps = G.fit(known, SETTINGS, rounds=25)
    assert len(passes) == steps.max() + 1  # a pass a step, and one for the curvature
    for s, setting in enumerate(SETTINGS):
        alone, took = G.fit(known, [setting], rounds=25)
        assert np.array_equal(took, steps[3 * s : 3 * s + 3])
        assert np.abs(alone - weights[3 * s : 3 * s + 3]).max() < 1e-9


def test_weights_are_at_their_optimum(articles):
    setting = G.Setting("x", min_df=2, tol=1e-9)
    known = G.prepared(articles, {}, [setting])
    weights, _ = G.fit(known, [setting], rounds=350)
    worker = G._Worker(known, [setting])
    rows = sorted(known.rows.collect(), key=lambda r: r.doc_id)
    assert len(rows) == 152 and {r.fold for r in rows} == {1, 2, 3}
    r = np.repeat(np.arange(len(rows)), [len(x.js) for x in rows])
    j = np.array([y for x in rows for y in x.js], dtype=int)
    v = 1 + np.log(np.array([y for x in rows for y in x.vs]))
    y = np.array([1.0 if x.label else -1.0 for x in rows])
    for m, f, x in worker.values(len(rows), r, j, v, [0, 1, 2]):
        train = np.array([q.fold != f + 1 for q in rows])
        dense = np.zeros((len(rows), worker.size))
        np.add.at(dense, (r, j), x)
        assert np.allclose(np.linalg.norm(dense, axis=1)[dense.any(axis=1)], 1)
        w, b = weights[m, :-1], weights[m, -1]
        short = np.maximum(0, 1 - y * (dense @ w + b)) * train
        assert np.abs(w - 2 * dense.T @ (y * short)).max() < 1e-2 and abs((y * short).sum()) < 1e-2


def test_search_ranks_what_helps_first(articles):
    rows = G.searched(articles, SETTINGS, extra(articles), rounds=60).collect()
    best = {r.setting: r for r in rows}
    assert [r.place for r in rows] == [1, 2, 3, 4] and len(best["a"].folds) == 3
    assert best["a"].f1 > 0.9 and best["d"].f1 < best["a"].f1
    assert best["a"].f1 == pytest.approx(np.mean(best["a"].folds))


def test_search_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, label int")
    assert [r.f1 for r in G.searched(none, SETTINGS[:2], rounds=3).collect()] == [0.0, 0.0]


def sparse(rng, n, slots):
    r = np.repeat(np.arange(n), 5)
    return N.Sparse(n, r, rng.integers(0, slots, len(r)), rng.normal(size=len(r)))


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    net = N.Network((12, 7, 5, 3), dropout=0.3, seed=3)
    x, y = sparse(rng, 9, 12), rng.integers(0, 3, 9)
    drops = net.drops(np.arange(9), 4)
    assert {len(d) for d in drops} == {9} and 0 < (drops[0] == 0).mean() < 0.7
    _, gradient = net.gradient(net.weights, x, y, drops)
    for k in rng.integers(0, len(net.weights), 60):
        up, down = net.weights.copy(), net.weights.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (net.gradient(up, x, y, drops)[0] - net.gradient(down, x, y, drops)[0]) / 2e-6
        assert slope == pytest.approx(gradient[k], rel=1e-4, abs=1e-6)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    rows = []
    for k in range(260):
        label = int(rng.random() < 0.35)
        text = [f"w{rng.randrange(50)}" for _ in range(20)] + rng.choices(["xx%%%", "yy%%%", "zz%%%"] if label else ["plain", "calm"], k=3)
        rows.append((k, " ".join(text), label, "dev" if k % 5 == 1 else "test" if k % 5 == 0 else "train"))
    rows += [(1000, None, 0, "train"), (1001, "w1", None, "train"), (1002, None, 1, "test")]
    return spark.createDataFrame(rows, "doc_id long, text string, label int, part string").repartition(3)


def f1(rows):
    hit = sum(r.label == r.predicted == 1 for r in rows)
    return 2 * hit / max(1, sum(r.label == 1 for r in rows) + sum(r.predicted == 1 for r in rows))


def test_network_learns_and_reruns_agree(planted):
    rows = N.ready(planted, 256)
    net, told = N.train(rows, N.Network((256, 20, 10, 2)), rounds=30)
    again, same = N.train(rows, N.Network((256, 20, 10, 2)), rounds=30)
    assert told == same and np.array_equal(net.weights, again.weights)
    assert told[-1][0] < told[0][0]
    held = N.predict(rows.filter("part = 'test'"), net).collect()
    assert f1(held) > 0.85 and len(held) == 53
    assert all(abs(sum(r.chances) - 1) < 1e-9 for r in held)


def test_frozen_layers_stay_and_patience_ends(planted):
    rows = N.ready(planted, 256)
    before = N.Network((256, 20, 10, 2))
    moved = N.with_new_head(before, 2)
    net, told = N.train(rows, moved, rounds=8, frozen=1)
    fixed = 256 * 20 + 20
    assert np.array_equal(net.weights[:fixed], before.weights[:fixed]) and not np.array_equal(net.weights[fixed:], moved.weights[fixed:])
    _, told = N.train(rows, N.Network((256, 20, 10, 2)), rounds=50, rate=5.0, patience=2)
    assert len(told) < 50


def test_partitions_do_not_matter(spark, planted):
    a, _ = N.train(N.ready(planted.coalesce(1), 64), N.Network((64, 8, 2)), rounds=4)
    b, _ = N.train(N.ready(planted.repartition(70), 64), N.Network((64, 8, 2)), rounds=4)
    assert np.abs(a.weights - b.weights).max() < 1e-9
