"""Deduplication, set operations, labels and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.numbering import numbered_within

#: Label maps by data set (fixed values): binary, then fine.
BINARY = {
    "liar": {"true": 0, "mostly-true": 0, "half-true": 0, "barely-true": 1, "false": 1, "pants-fire": 1},
    "combined": {"ftrue": 0, "mtrue": 0, "mfalse": 1, "ffalse": 1, "mixture": 4, "pantsfire": 5, "nofact": 6},
    "rashkin": {"1": 1, "2": 1, "3": 1, "4": 0},
    "buzzfeed": {"mostly true": 0, "mostly false": 1, "mixture of true and false": 5, "no factual content": 5},
    "snopes": {"ftrue": 0, "mtrue": 0, "mfalse": 1, "ffalse": 1, "mixture": 5},
    "snopes312": {"true": 0, "mostly true": 0, "false": 1, "mostly false": 1, "mixture": 5},
    "emergent": {"true": 0, "false": 1, "unknown": 5},
    "perez": {"legit": 0, "fake": 1},
}
FINE = {
    "combined": {"ftrue": 0, "mtrue": 1, "mixture": 2, "mfalse": 3, "ffalse": 4, "pantsfire": 5, "nofact": 6},
    "rashkin": {"1": 2, "2": 3, "3": 1, "4": 0},
    "buzzfeed": {"no factual content": 0, "mostly true": 1, "mixture of true and false": 2, "mostly false": 3},
    "snopes": {"ftrue": 0, "mtrue": 1, "mixture": 2, "mfalse": 3, "ffalse": 4},
    "snopes312": {"true": 1, "mostly true": 2, "mixture": 3, "mostly false": 4, "false": 5},
    "emergent": {"unknown": 0, "true": 1, "false": 2},
}
RATINGS = {"false": "ffalse", "true": "ftrue", "mostly false": "mfalse", "mixture": "mixture", "mostly true": "mtrue"}


def recode(c, mapping: dict, strict: bool = False) -> Column:
    """LBL-01: the mapped value; null for an unknown label, or an error if ``strict``."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(None)
    for k, v in reversed(mapping.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    if strict:
        return F.when(c.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), c.cast("string")))).otherwise(out)
    return out


def codes(rows: DataFrame, label: str) -> DataFrame:
    """LBL-02: codes in alphabetical order of the labels, ranked over the distinct labels alone."""
    ranked = rows.select(label).distinct().withColumn("code", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return rows.join(ranked, label)  # broadcast only if Spark finds it small


def one_hot(c: Column, n: int, first: int = 0) -> Column:
    """LBL-06."""
    return F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda k: (k == c).cast("double"))


def soft(c: Column, n: int) -> Column:
    """LBL-04: a rating between whole labels, shared by the two next to it."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.greatest(F.lit(0.0), 1 - F.abs(c - k)))


def expectation(p: Column) -> Column:
    """LBL-05, as a mean."""
    return F.aggregate(F.transform(p, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def argmax(p: Column) -> Column:
    """LBL-05, as a class."""
    return F.array_position(p, F.array_max(p))


def keep_first(rows: DataFrame, keys: list[str], *order: str, last: bool = False) -> DataFrame:
    """DED-02, DED-04: of rows that agree in ``keys`` the first by ``order``, or the last; nulls come first.

    Each task keeps a row a key before the shuffle, so a text of many rows is no burden.
    """
    others = [c for c in rows.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*[F.col(f"`{c}`") for c in others]), F.struct(*order))
    best = rows.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(pick.alias("_best"))
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_best.`{c}`").alias(c) for c in rows.columns])


def keep_first_but(rows: DataFrame, ignored: list[str], *order: str, last: bool = False) -> DataFrame:
    """DED-03: of rows that agree in all columns but some."""
    return keep_first(rows, [c for c in rows.columns if c not in ignored], *order, last=last)


def without_overlap(test: DataFrame, train: DataFrame, key: Column) -> DataFrame:
    """DED-05: test rows whose normalised claim is not in the training rows."""
    seen = train.select(key.alias("_k")).distinct()
    return test.withColumn("_k", key).join(seen, "_k", "left_anti").drop("_k")


def ticket(key: str, seed: int) -> list[Column]:
    """An order that looks random and stays: a hash of key and seed, then the key."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), F.col(key)]


def balance(rows: DataFrame, label: str, key: str, n: int | None, discard: tuple = (), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """SMP-01: (balanced, remaining).  ``n`` rows of each class, repeated if it has fewer (``copy`` counts them); all if n is None."""
    kept = rows.filter(~F.col(label).isin(*discard)) if discard else rows
    if n is None:
        return kept.withColumn("copy", F.lit(0)), rows.limit(0)
    numbered = numbered_within(kept, [label], ticket(key, seed))
    copies = F.when(F.col("_f") >= n, (F.col("_r") <= n).cast("int")).otherwise(F.floor((n - F.col("_r")) / F.col("_f")).cast("int") + 1)
    chosen = numbered.withColumn("_c", copies).filter("_c > 0")
    balanced = chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).drop("_r", "_f", "_c")
    return balanced, rows.join(chosen.select(key), key, "left_anti")


def other_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """SET-04: the names of ``a``'s columns that ``b`` lacks."""
    return [c for c in a.columns if c not in b.columns]


def split_ranges(rows: DataFrame, label: str, key: str, sizes: dict[str, int], seed: int = 0, discard: tuple = ()) -> DataFrame:
    """SMP-02, SMP-09: so many rows a class for each part in turn, none of the classes ``discard``."""
    kept = rows.filter(~F.col(label).isin(*discard)) if discard else rows
    numbered = numbered_within(kept, [label], ticket(key, seed))
    part, low = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        part = F.when((F.col("_r") > low) & (F.col("_r") <= low + n), name).otherwise(part)
        low += n
    return numbered.withColumn("part", part).filter("part IS NOT NULL").drop("_r", "_f")


def split_fractions(rows: DataFrame, key: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """SMP-04, SMP-06: parts by hash, without a shuffle; no row is lost at a boundary."""
    u = F.conv(F.substring(ticket(key, seed)[0], 1, 8), 16, 10).cast("double") / float(1 << 32)
    part, low = None, 0.0
    for name, share in fractions.items():
        low += share
        part = F.when(u < low, name) if part is None else part.when(u < low, name)
    return rows.withColumn("part", part.otherwise(name))


def folds(rows: DataFrame, label: str, order: str, k: int = 3) -> DataFrame:
    """SMP-07: contiguous blocks of each class, the first ones a row longer where ``k`` does not divide it."""
    numbered = numbered_within(rows, [label], [order])
    size, over = F.floor(F.col("_f") / k), F.col("_f") % k
    longer = over * (size + 1)  # rows in the longer blocks
    fold = F.when(F.col("_r") <= longer, F.ceil(F.col("_r") / (size + 1))).otherwise(over + F.ceil(F.try_divide(F.col("_r") - longer, size)))
    return numbered.withColumn("fold", fold.cast("int")).drop("_r", "_f")
