"""Counts, crosstabs and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers in the order that settles ties (fixed values for the crowd's question).
OPTIONS = ("context", "debunking", "right", "irrelevant", "ambiguous")


def crosstab(rows: DataFrame, by: str, over: str, values: list) -> DataFrame:
    """AGG-04."""
    return rows.groupBy(by).pivot(over, values).agg(F.count(F.lit(1))).fillna(0)


def crosstab_margins(rows: DataFrame, by: str, over: str) -> DataFrame:
    """AGG-05: long form; null stands for all."""
    return rows.cube(by, over).agg(F.count("*").alias("n"))


def describe(rows: DataFrame, c: str) -> DataFrame:
    """AGG-03: count, unique, top and its frequency; ties go to the smaller value."""
    counts = rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col(c).alias("v")))
    return counts.agg(F.sum("n").alias("count"), F.count("*").alias("unique"), top.alias("t")).select("count", "unique", F.col("t.v").alias("top"), (-F.col("t.n")).alias("freq"))


def majority(votes: DataFrame, item: str, answer: str, options: tuple = OPTIONS) -> DataFrame:
    """AGG-08, AGG-09: each item's winning answer (ties by the order of options), its votes, all votes, the share."""
    n = [F.count_if(F.col(answer) == o).alias(f"_n{k}") for k, o in enumerate(options)]
    counted = votes.filter(F.col(answer).isin(*options)).groupBy(item).agg(*n)
    names = [F.col(f"_n{k}") for k in range(len(options))]
    most, every = F.greatest(*names), reduce(lambda a, b: a + b, names)
    winner = F.coalesce(*[F.when(c == most, o) for c, o in zip(names, options, strict=True)])
    return counted.select(item, winner.alias("winner"), most.alias("votes"), every.alias("all_votes"), (most / every).alias("agreement"))


def consensus(a, b, adjudicator):
    """AGG-14: two annotators' label if they agree, else the adjudicator's."""
    return F.when(F.col(a) == F.col(b), F.col(a)).otherwise(F.col(adjudicator))
