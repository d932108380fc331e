"""p-values of F scores, the best percentile of features, and recursive elimination.

The tail of the F distribution is a regularised incomplete beta function,
computed as a Column: its continued fraction (modified Lentz) on the side where
it converges, the factor in front of it in logarithms, so that p-values far out
in the tail keep their digits down to 1e-300.  Recursive elimination fits a
logistic regression by Newton steps whose sums of products are one aggregation
of built-in functions a step; each round starts from the weights of the round
before, without the feature that went.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS, TINY = 300, 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0: Stirling's series ten places further on, and back by the recurrence."""
    back = sum((F.log(x + k) for k in range(1, 10)), F.log(x))
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - back


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, x below (a + 1) / (a + b + 2)."""

    def held(v: Column) -> Column:
        return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def step(s: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        def turned(t: Column, c: Column) -> Column:
            # t.d and t.c may be small; the ratio's two parts are kept in a struct, so that each is computed once
            return F.transform(
                F.array(F.struct((1 / held(1 + c * t["d"])).alias("d"), held(1 + c / t["c"]).alias("c"), t["h"].alias("h"))),
                lambda u: F.struct(u["d"].alias("d"), u["c"].alias("c"), (u["h"] * u["d"] * u["c"]).alias("h")),
            )[0]

        once = F.transform(F.array(turned(s, even)), lambda t: turned(t, odd))[0]
        moved = F.transform(F.array(once), lambda t: F.struct(t["d"].alias("d"), t["c"].alias("c"), t["h"].alias("h"), (F.abs(t["h"] - s["h"]) <= 1e-16 * F.abs(t["h"])).alias("done")))[0]
        return F.when(s["done"], s).otherwise(moved)

    d = 1 / held(1 - (a + b) * x / (a + 1))
    start = F.struct(d.alias("d"), F.lit(1.0).alias("c"), d.alias("h"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def incomplete_beta(x: Column, y: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function at x; ``y`` is 1 - x, given so that neither loses digits."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(y))
    near = front * _fraction(x, a, b) / a
    far = 1 - front * _fraction(y, b, a) / b
    return F.when(x <= 0, F.lit(0.0)).when(y <= 0, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), near).otherwise(far)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """The chance of an F of d1 and d2 degrees of freedom, or a larger one; null for a null or a negative F, 0 for an infinite one."""
    d1, d2 = d1.cast("double"), d2.cast("double")
    all_ = d2 + d1 * f
    p = incomplete_beta(d2 / all_, d1 * f / all_, d2 / 2, d1 / 2)
    return F.when(f.isNull() | F.isnan(f) | (f < 0) | (d2 <= 0), F.lit(None).cast("double")).when(f == float("inf"), F.lit(0.0)).otherwise(p)


def with_p(scores: DataFrame, n: int) -> DataFrame:
    """SEL-02: ``scores`` (feature, f) of ``n`` documents, with the p-value of f."""
    return scores.withColumn("p_value", f_tail(F.col("f"), F.lit(1), F.lit(n - 2)))


def best_percentile(scores: DataFrame, percent: float, score: str = "f") -> DataFrame:
    """SEL-02: the features whose score exceeds the percentile that ``percent`` % of them exceed; of those at it, the first by name, up to ``percent`` %.

    A row a feature is counted; null scores are the lowest.
    """
    scored = scores.withColumn("_s", F.coalesce(score, F.lit(float("-inf"))))
    limit = scored.agg(F.percentile("_s", 1 - percent / 100).alias("_t"), F.floor(F.count("*") * percent / 100).alias("_n"))
    marked = scored.crossJoin(F.broadcast(limit))  # one row
    above = marked.filter("_s > _t")
    tied = marked.filter("_s = _t").withColumn("_r", F.row_number().over(Window.partitionBy("_t").orderBy("feature")))
    room = above.agg(F.count("*").alias("_k"))
    kept = tied.crossJoin(F.broadcast(room)).filter(F.col("_r") + F.col("_k") <= F.col("_n"))  # one row
    return above.select(*scores.columns).unionByName(kept.select(*scores.columns))


def logistic(rows: DataFrame, features: list[str], label: str = "label", start: dict[str, float] | None = None, ridge: float = 1.0, rounds: int = 50) -> tuple[dict[str, float], int]:
    """Weights (and that of ``_bias``) of a logistic regression, and the Newton steps it took.

    The loss is summed over rows, plus half of ``ridge`` times the squared
    weights but for the bias.  A step is one aggregation: a gradient and a
    matrix, as wide as the features.
    """
    names = [*features, "_bias"]
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    w = np.array([(start or {}).get(f, 0.0) for f in names])
    keep = np.array([ridge] * len(features) + [0.0])
    y = F.col(label).cast("double")

    def moments(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((c * float(v) for c, v in zip(x, w, strict=True)), F.lit(0.0))
        with_p = rows.select(*[c.alias(f"_x{k}") for k, c in enumerate(x)], y.alias("_y"), z.alias("_z")).withColumn("_p", 1 / (1 + F.exp(-F.col("_z"))))
        loss = F.sum(F.greatest("_z", F.lit(0.0)) - F.col("_z") * F.col("_y") + F.log1p(F.exp(-F.abs("_z"))))
        g = [F.sum((F.col("_p") - F.col("_y")) * F.col(f"_x{k}")) for k in range(len(x))]
        pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
        h = [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs]
        got = np.array([v if v is not None else 0.0 for v in with_p.agg(loss, *g, *h).first()])
        matrix = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, got[1 + len(x) :], strict=True):
            matrix[i, j] = matrix[j, i] = v
        return got[0] + float(keep @ (w * w)) / 2, got[1 : 1 + len(x)] + keep * w, matrix + np.diag(keep)

    loss, gradient, matrix = moments(w)
    for k in range(rounds):
        move = np.linalg.lstsq(matrix + 1e-12 * np.eye(len(w)), gradient, rcond=None)[0]
        if gradient @ move < 1e-18 * (1 + abs(loss)):
            return dict(zip(names, w.tolist(), strict=True)), k
        size = 1.0
        while (tried := moments(w - size * move))[0] > loss - 1e-4 * size * float(gradient @ move) and size > 1e-8 and abs(tried[0] - loss) > 1e-13 * (1 + abs(loss)):
            size /= 2
        w, (loss, gradient, matrix) = w - size * move, tried
    return dict(zip(names, w.tolist(), strict=True)), rounds


def standardised(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with the features as numbers of standard deviations from their mean; constant ones become 0."""
    told = rows.agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{k}") for k, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    wide = rows.crossJoin(F.broadcast(told))  # one row
    new = {c: F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"_m_{k}"), F.col(f"_s_{k}")), F.lit(0.0)) for k, c in enumerate(features)}
    return wide.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def eliminated(rows: DataFrame, features: list[str], keep: int | None = None, label: str = "label", ridge: float = 1.0, warm: bool = True) -> list[tuple[str, int, int]]:
    """SEL-03: (feature, rank, steps): rank 1 for those that stay, then the later the better; ``steps`` it took to fit without it.

    Each round drops the feature of the smallest squared weight, the last by
    name of equal ones, until ``keep`` (half of them by default) are left.
    """
    left, keep = sorted(features), len(features) // 2 if keep is None else keep
    weights, steps = logistic(rows, left, label, None, ridge)
    gone: list[tuple[str, int]] = []
    while len(left) > max(keep, 1):
        worst = min(left, key=lambda f: (weights[f] ** 2, [-ord(c) for c in f]))
        left.remove(worst)
        weights, steps = logistic(rows, left, label, weights if warm else None, ridge)
        gone.append((worst, steps))
    ranks = [(f, k + 2, s) for k, (f, s) in enumerate(reversed(gone))]
    return sorted([(f, 1, 0) for f in left] + ranks, key=lambda r: (r[1], r[0]))
