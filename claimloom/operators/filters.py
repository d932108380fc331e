"""Filters and the site cleaner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import web as W
from claimloom.resources.words import BOILERPLATE


def right_length(c) -> Column:
    """FLT-01: at least 100 and under 30,000 words with a letter."""
    return F.width_bucket(T.count_words(c).cast("double"), F.lit(100.0), F.lit(30000.0), F.lit(1)) == 1  # the words are counted once


def boilerplate(c) -> Column:
    """FLT-03."""
    return reduce(lambda a, b: a | b, [T.col(c).contains(p) for p in BOILERPLATE])


def clean_site(rows: DataFrame, text: str, others: tuple[str, ...] = (), url: str | None = None, error: str | None = None, mode: str = "cli", order: str = "web") -> DataFrame:
    """FLT-06: rows without error, not of a fact-checker, of the right length, without boilerplate, cleaned.

    FLT-07: in ``web`` mode rows that fail the last two are kept as they are.
    """
    if error is not None:
        rows = rows.filter(F.col(error) == "No Error")
    if url is not None:
        rows = rows.filter(~T.from_debunker(url))
    ok = right_length(text) & ~boilerplate(text)
    if mode == "cli":
        rows = rows.filter(ok)
    cleaned = {c: T.clean_text(c, order) for c in (text, *others)}
    return rows.withColumns({c: v if mode == "cli" else F.when(ok, v).otherwise(F.col(c)) for c, v in cleaned.items()})


def of_large_groups(rows: DataFrame, key: str, more_than: int) -> DataFrame:
    """FLT-11: rows whose key has more than so many rows."""
    large = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > more_than).select(key)
    return rows.join(large, key, "left_semi")


def first_citations(rows: DataFrame, url: str, is_first: str) -> DataFrame:
    """FLT-12."""
    return rows.filter(F.col(is_first) & ~W.is_media(url))


def funnel(rows: DataFrame, text: str, keys: list[str], order: str) -> DataFrame:
    """AGG-12: how many rows each step of cleaning takes; a row a group of duplicates is looked at."""
    first = [] if text in keys else [F.min_by(text, order).alias(text)]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *first)
    long_enough, short_enough = F.size(T.words(text)) > 40, F.length(text) < 30000
    bad, plain = boilerplate(text), T.is_ascii(text)
    count = lambda *c: F.count_if(reduce(lambda a, b: a & b, c))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("with_duplicates"),
        F.count("*").alias("without_duplicates"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("duplicates"),
        count(~long_enough).alias("short_text"),
        count(long_enough, ~short_enough).alias("long_text"),
        count(long_enough, short_enough, bad).alias("unwanted_text"),
        count(long_enough, short_enough, ~bad, ~plain).alias("non_ascii"),
    )
