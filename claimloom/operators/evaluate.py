"""Evaluation of predictions (columns label, predicted, score) as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.numbering import running


def confusion(rows: DataFrame) -> DataFrame:
    """EVL-01: (label, predicted, n)."""
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def per_class(rows: DataFrame) -> DataFrame:
    """EVL-04: (class, precision, recall, f1, support); what is divided by none is 0."""
    pairs = confusion(rows)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(1).alias("real")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("real")))).alias("x"), "label", "predicted", "n")
    by = ends.groupBy("x.class").agg(
        F.sum(F.when((F.col("x.real") == 1) & (F.col("label") == F.col("predicted")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.real") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.real") == 0, F.col("n")).otherwise(0)).alias("guessed"),
    )
    p, r = F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return by.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support", "tp")


def report(rows: DataFrame) -> DataFrame:
    """EVL-02: a row a class and the micro, macro and weighted averages."""
    each = per_class(rows)
    n = F.sum("support")
    micro = F.sum("tp") / n
    average = each.agg(
        F.array(
            F.struct(F.lit("micro avg").alias("name"), micro.alias("precision"), micro.alias("recall"), micro.alias("f1"), n.alias("support")),
            F.struct(F.lit("macro avg").alias("name"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support")),
            F.struct(F.lit("weighted avg").alias("name"), *[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in ("precision", "recall", "f1")], n.alias("support")),
        ).alias("a")
    ).select(F.explode("a").alias("x"))
    one = each.select(F.col("class").cast("string").alias("name"), "precision", "recall", "f1", "support")
    return one.unionByName(average.select("x.*"))


def summary(rows: DataFrame) -> DataFrame:
    """EVL-03, EVL-05: accuracy, squared error and correlation."""
    y, p = F.col("label").cast("double"), F.col("predicted").cast("double")
    return rows.agg(F.avg((y == p).cast("double")).alias("accuracy"), F.avg((y - p) * (y - p)).alias("mse"), F.corr(y, p).alias("pearson"))


def _points(rows: DataFrame) -> DataFrame:
    """Positive (p) and negative (n) rows a distinct score, with their sums from the highest score down."""
    by = rows.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    return running(by, F.desc("score"), ["p", "n"])


def roc(rows: DataFrame) -> DataFrame:
    """EVL-07: (score, fpr, tpr): a point a distinct score, from high to low; a rate without rows to count is null."""
    return _points(rows).select("score", F.try_divide("upto_n", "all_n").alias("fpr"), F.try_divide("upto_p", "all_p").alias("tpr"))


def auc(rows: DataFrame) -> DataFrame:
    """EVL-07: the area by trapezoids; null where one class has no row."""
    area = F.try_divide("n", "all_n") * F.try_divide(2 * F.col("upto_p") - F.col("p"), "all_p") / 2
    return _points(rows).select(area.alias("a")).agg(F.sum("a").alias("auc"))
