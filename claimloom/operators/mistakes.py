"""Learners that move by their mistakes, one row after another: perceptron, passive-aggressive, stochastic hinge loss.

Such a learner depends on the order of rows.  Rows are numbered in an order by
hash and dealt to shards of ``per`` rows; in an epoch each shard passes over
its rows in order, from weights that all shards begin with, and the weights are
then averaged by shard sizes.  So the result follows from rows, ``per`` and
seed, whatever the partitions.  All learners pass over a row together; one that
made no move in an epoch is done.

Rows without a label take no part; label 1 is one side, every other the other.
A row without features moves and is judged by the bias alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.numbering import numbered
from claimloom.operators.relational import ticket
from claimloom.operators.sparse import parts, products
from claimloom.operators.storage import written
from claimloom.operators.sums import summed


@dataclass(frozen=True)
class Learner:
    """``kind``: ``perceptron``; ``passive`` with the largest step ``c``; ``hinge`` with the l2 weight ``alpha`` and falling steps."""

    name: str
    kind: str
    c: float = 1.0
    alpha: float = 1e-4


#: The passive-aggressive learner takes a margin this near to 1 for 1, which its steps only approach.
NEAR = 1e-6
#: The hinge learner's bias moves by this part of a step, since every row has it.
BIAS = 0.01


class Walk:
    """One learner's pass over one shard; ``weights`` end with the bias, ``seen`` rows came before."""

    def __init__(self, learner: Learner, weights: np.ndarray, seen: int):
        self.learner, self.w, self.b, self.scale, self.moves = learner, weights[:-1].copy(), float(weights[-1]), 1.0, 0
        self.t = seen + 1 / (learner.alpha * np.sqrt(1 / np.sqrt(learner.alpha)))  # the first step is 1 / sqrt(sqrt(alpha))

    def row(self, j: np.ndarray, v: np.ndarray, y: float) -> None:
        margin = y * (self.scale * (self.w[j] @ v) + self.b)
        if self.learner.kind == "hinge":
            step = 1 / (self.learner.alpha * self.t)
            self.t += 1
            self.scale *= 1 - step * self.learner.alpha
            if margin < 1:
                self._move(j, v, y * step, BIAS)
        elif self.learner.kind == "perceptron":
            if margin <= 0:
                self._move(j, v, y, 1.0)
        elif margin < 1 - NEAR:
            self._move(j, v, y * min(self.learner.c, (1 - margin) / (v @ v + 1)), 1.0)

    def _move(self, j, v, step, bias):
        self.w[j] += step / self.scale * v
        self.b += step * bias
        self.moves += 1

    def end(self) -> np.ndarray:
        return np.append(self.w * self.scale, self.b)


def dealt(rows: DataFrame, per: int = 20_000, seed: int = 0) -> tuple[DataFrame, int]:
    """Saved rows (shard, place, y, js, vs) of (doc_id, label, js, vs), each shard in order in one partition; and how many."""
    rows = rows.filter("label IS NOT NULL")
    placed = written(numbered(rows.select("doc_id"), ticket("doc_id", seed), "place"))  # keys alone
    n = placed.count()
    shard = F.floor((F.col("place") - 1) / per).cast("int")
    every = rows.join(placed, "doc_id").select(shard.alias("shard"), "place", F.when(F.col("label") == 1, 1.0).otherwise(-1.0).alias("y"), "js", "vs")
    return written(every.repartition(max(1, -(-n // per)), "shard").sortWithinPartitions("shard", "place")), n


def fit(rows: DataFrame, d: int, learners: list[Learner], epochs: int = 50, per: int = 20_000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, epochs): a row a learner, its weights of ``d`` features and bias, and the epochs that it took."""
    spark = rows.sparkSession
    held, n = dealt(rows, per, seed)
    count = held.rdd.getNumPartitions()
    weights, took = np.zeros((len(learners), d + 1)), np.zeros(len(learners), dtype=int)
    active = list(range(len(learners))) if n else []
    for epoch in range(epochs):
        if not active:
            break
        shared = spark.sparkContext.broadcast((weights[active], [learners[k] for k in active]))  # as large as the vocabulary times the learners

        def work(batches, shared=shared, epoch=epoch):
            begin, chosen = shared.value
            out = np.zeros((len(chosen), d + 2))  # weights and bias, moves
            now, walks, size = None, [], 0

            def close():
                for k, walk in enumerate(walks):
                    out[k, :-1] += size * walk.end()
                    out[k, -1] += walk.moves

            for few, ends, j, v in parts(batches):
                shards, y = few.column("shard").to_numpy(), few.column("y").to_numpy()
                for r in range(few.num_rows):
                    if shards[r] != now:
                        close()
                        now, size = shards[r], 0
                        before = epoch * int(min(per, n - now * per))
                        walks = [Walk(learner, w, before) for learner, w in zip(chosen, begin, strict=True)]
                    size += 1
                    at = slice(ends[r], ends[r + 1])
                    for walk in walks:
                        walk.row(j[at], v[at], y[r])
            close()
            return out.ravel()

        found = summed(held, count, work, len(active) * (d + 2)).reshape(len(active), d + 2)
        shared.unpersist()
        weights[active] = found[:, :-1] / n
        took[active] = epoch + 1
        active = [k for k, moves in zip(active, found[:, -1], strict=True) if moves]
    return weights, took


def decided(rows: DataFrame, weights: np.ndarray, learners: list[Learner]) -> DataFrame:
    """(doc_id, learner, decision, predicted) of (doc_id, js, vs): a row a document and learner."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    names = [x.name for x in learners]

    def run(batches):
        w = shared.value
        for few, ends, j, v in parts(batches):
            value = products(ends, j, v, np.ascontiguousarray(w[:, :-1].T)) + w[:, -1]
            n = few.num_rows
            yield pa.RecordBatch.from_arrays(
                [few.column("doc_id").take(pa.array(np.repeat(np.arange(n), len(names)))), pa.array(names * n), pa.array(value.ravel()), pa.array((value.ravel() > 0).astype(np.int32))],
                ["doc_id", "learner", "decision", "predicted"],
            )

    return rows.select("doc_id", "js", "vs").mapInArrow(run, "doc_id long, learner string, decision double, predicted int")
