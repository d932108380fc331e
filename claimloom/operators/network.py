"""A feed-forward network trained by partitions: rounds of gradients, summed in a tree.

The input is a sparse vector a row (hashed words and word ends, of length 1),
then dense layers with relu and dropout, then a softmax.  A round computes each
partition's gradient on its own rows; the driver sees their sum alone, clips
its length, warms the step up and moves the weights by Adam.  The loss of the
rows kept for development comes with the same pass; when it has not fallen for
``patience`` rounds, training ends and the best weights stay.  Layers may be
frozen: a network that was trained on one task keeps its first layers and
learns another task's answer on top of them.

Dropout depends on the round and the row alone, so reruns agree.  A null text
has no features and is scored by the biases.  Rows without a label are not
trained on.  Weights are as many as the layers have, however many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.storage import written
from claimloom.operators.sums import summed


def hashed_text(c: Column | str, slots: int) -> Column:
    """Array of (j, v): hashed words and their last three signs, 1 + ln of their number, of length 1."""
    c = F.col(c) if isinstance(c, str) else c
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    both = F.concat(words, F.transform(words, lambda w: F.concat(F.lit(" "), F.substring(w, -3, 3))))
    slot = F.array_sort(F.transform(both, lambda w: F.pmod(F.xxhash64(w), F.lit(slots)).cast("int")))
    return slot


@dataclass
class Network:
    sizes: tuple[int, ...]  # slots, hidden layers, classes
    dropout: float = 0.2
    seed: int = 1
    weights: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.weights is None:
            rng = np.random.default_rng(self.seed)
            parts = []
            for a, b in zip(self.sizes, self.sizes[1:], strict=False):
                parts += [rng.normal(0, np.sqrt(2 / min(a, 256)), a * b), np.zeros(b)]
            self.weights = np.concatenate(parts)

    def layers(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def mask(self, frozen: int) -> np.ndarray:
        """1 for the weights that may move, 0 for those of the first ``frozen`` layers."""
        fixed = sum(a * b + b for a, b in list(zip(self.sizes, self.sizes[1:], strict=False))[:frozen])
        return (np.arange(len(self.weights)) >= fixed).astype(float)

    def forward(self, weights: np.ndarray, rows: "Sparse", drops: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """The layers' outputs, and the classes' chances."""
        held, layers = [], self.layers(weights)
        x = rows.times(layers[0][0]) + layers[0][1]
        for k, (w, b) in enumerate(layers[1:]):
            x = np.maximum(x, 0.0)
            if drops is not None:
                x = x * drops[k]
            held.append(x)
            x = x @ w + b
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return held, x / x.sum(axis=1, keepdims=True)

    def drops(self, keys: np.ndarray, round_: int) -> list[np.ndarray]:
        """Dropout of each hidden layer, by a mix of the row's key, the round and the unit."""
        out = []
        for k, size in enumerate(self.sizes[1:-1]):
            with np.errstate(over="ignore"):
                h = (keys.astype(np.uint64)[:, None] + np.uint64(round_ * 1_000_003 + k * 7919)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(size, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            out.append(((h >> np.uint64(40)) / float(1 << 24) >= self.dropout) / (1 - self.dropout))
        return out

    def gradient(self, weights: np.ndarray, rows: "Sparse", labels: np.ndarray, drops: list[np.ndarray] | None = None) -> tuple[float, np.ndarray]:
        """The loss summed over rows, and its gradient."""
        held, p = self.forward(weights, rows, drops)
        loss = -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).sum()
        pull, parts = p.copy(), []
        pull[np.arange(len(labels)), labels] -= 1
        layers = self.layers(weights)
        for k in range(len(layers) - 1, 0, -1):
            parts = [(held[k - 1].T @ pull).ravel(), pull.sum(axis=0), *parts]
            pull = pull @ layers[k][0].T * (held[k - 1] > 0)
            if drops is not None:
                pull = pull * drops[k - 1]
        return loss, np.concatenate([rows.transposed(pull, self.sizes[0]).ravel(), pull.sum(axis=0), *parts])


class Sparse:
    """Rows of features, as (row, j, v)."""

    def __init__(self, n: int, r: np.ndarray, j: np.ndarray, v: np.ndarray):
        self.n, self.r, self.j, self.v = n, r, j, v
        self._dense: np.ndarray | None = None

    def dense(self, size: int) -> np.ndarray:
        """The rows as a matrix: few rows at a time, whose products are then of matrices."""
        if self._dense is None:
            self._dense = np.bincount(self.r * size + self.j, self.v, self.n * size).reshape(self.n, size)
        return self._dense

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.dense(len(w)) @ w

    def transposed(self, pull: np.ndarray, size: int) -> np.ndarray:
        return self.dense(size).T @ pull


def read(batch: pa.RecordBatch, most: int = 256) -> Iterator[tuple[int, Sparse]]:
    """(first row, features) of up to ``most`` rows at a time of a column ``slots``: sorted slots, repeats included."""
    for at in range(0, batch.num_rows, most):
        column = batch.column("slots").slice(at, most)
        n = len(column)
        r, j = np.repeat(np.arange(n), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy()
        begins = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (j[1:] != j[:-1]))) if len(r) else np.zeros(0, dtype=np.int64)
        v = 1 + np.log(np.diff(np.append(begins, len(r))))
        r, j = r[begins], j[begins]
        norm = np.sqrt(np.bincount(r, v * v, n))
        yield at, Sparse(n, r, j, v / norm[r])


def ready(rows: DataFrame, slots: int) -> DataFrame:
    """(doc_id, label, part, slots) of (doc_id, text, label, part), saved; part is 'train', 'dev' or another."""
    return written(rows.select("doc_id", F.col("label").cast("int").alias("label"), "part", hashed_text("text", slots).alias("slots")))


def train(rows: DataFrame, net: Network, rounds: int = 40, rate: float = 0.01, clip: float = 1.0, warm_up: int = 4, patience: int = 6, frozen: int = 0) -> tuple[Network, list[tuple[float, float]]]:
    """The network with the weights of the least loss on 'dev', and (loss on 'train', loss on 'dev') a round; means over rows."""
    spark, parts, size = rows.sparkSession, rows.rdd.getNumPartitions(), len(net.weights)
    weights, best, least, waited = net.weights.copy(), net.weights.copy(), np.inf, 0
    first, second, mask, told = np.zeros(size), np.zeros(size), net.mask(frozen), []
    used = rows.filter("label IS NOT NULL AND part IN ('train', 'dev')")
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((Network(net.sizes, net.dropout, net.seed, weights), k))

        def work(batches, shared=shared):
            model, k = shared.value
            out = np.zeros(len(model.weights) + 4)
            for batch in batches:
                labels, keys = batch.column("label").to_numpy(), np.abs(batch.column("doc_id").fill_null(0).to_numpy())
                training = np.array([p == "train" for p in batch.column("part").to_pylist()])
                for at, x in read(batch):
                    to = at + x.n
                    for which, here in ((0, training[at:to]), (1, ~training[at:to])):
                        if not here.any():
                            continue
                        mine = np.flatnonzero(here)
                        back = np.full(x.n, -1)
                        back[mine] = np.arange(len(mine))
                        own = here[x.r]
                        some = Sparse(len(mine), back[x.r[own]], x.j[own], x.v[own])
                        if which == 0:
                            loss, gradient = model.gradient(model.weights, some, labels[at:to][mine], model.drops(keys[at:to][mine], k) if model.dropout else None)
                            out[:-4] += gradient
                        else:
                            p = model.forward(model.weights, some)[1]
                            loss = -np.log(np.maximum(p[np.arange(len(mine)), labels[at:to][mine]], 1e-300)).sum()
                        out[-4 + 2 * which] += loss
                        out[-3 + 2 * which] += len(mine)
            return out

        found = summed(used, parts, work, size + 4)
        shared.unpersist()
        loss, n, dev, n_dev = found[-4:]
        told.append((loss / max(n, 1), dev / max(n_dev, 1)))
        if n_dev and told[-1][1] < least - 1e-6:
            least, best, waited = told[-1][1], weights.copy(), 0
        elif n_dev and (waited := waited + 1) >= patience:
            break
        elif not n_dev:
            best = weights.copy()
        gradient = found[:-4] / max(n, 1) * mask
        gradient *= min(1.0, clip / max(np.linalg.norm(gradient), 1e-12))
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = rate * min(1.0, (k + 1) / warm_up)
        weights = weights - mask * step * (first / (1 - 0.9 ** (k + 1))) / (np.sqrt(second / (1 - 0.999 ** (k + 1))) + 1e-8)
    return Network(net.sizes, net.dropout, net.seed, best), told


def with_new_head(net: Network, classes: int, seed: int = 2) -> Network:
    """The network with a last layer of its own for another task."""
    fresh = Network((*net.sizes[:-1], classes), net.dropout, seed)
    kept = sum(a * b + b for a, b in list(zip(net.sizes, net.sizes[1:], strict=False))[:-1])
    fresh.weights[:kept] = net.weights[:kept]
    return fresh


def predict(rows: DataFrame, net: Network) -> DataFrame:
    """(doc_id, label, predicted, chances) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            chances = [model.forward(model.weights, x)[1] for _, x in read(batch)]
            p = np.concatenate(chances) if chances else np.zeros((0, model.sizes[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "label", "predicted", "chances"])

    return rows.select("doc_id", "label", "slots").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, predicted int, chances array<double>")
