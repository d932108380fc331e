"""Registration of queries with the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Labelled articles in SQL: the verdict stands for (quality, toxic).
ARTICLES = """articles AS (
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'ftrue' WHEN quality = 1 THEN 'mixture' WHEN toxic = 0 THEN 'mfalse' ELSE 'ffalse' END AS rating
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
#: Their binary label: 0 true, 1 false.
CLASSED = ARTICLES + ", classed AS (SELECT *, CASE WHEN rating IN ('ftrue', 'mixture') THEN 0 ELSE 1 END AS label FROM articles)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled articles with their verdict."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rating = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ftrue").when(F.col("quality") == 1, "mixture").when(F.col("toxic") == 0, "mfalse").otherwise("ffalse")
    return d.join(l, "doc_id").select("doc_id", "text", "lang", "source", "quality", "toxic", rating.alias("rating"))


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).withColumn("label", F.when(F.col("rating").isin("ftrue", "mixture"), 0).otherwise(1))


def quoted(words) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
