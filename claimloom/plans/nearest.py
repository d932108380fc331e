"""Queries of nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import neighbours as K
from claimloom.plans.base import query, table

_KNN = """WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2 FOR i IN range(1, 65)]), 9) AS square FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 10 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY square, vec_id) AS rank FROM d QUALIFY rank <= 10)"""


@query("mdl_05_nearest", _KNN + " SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(square, 6) AS square FROM k")
def mdl_05_nearest(spark, sf_dir):
    """The ten nearest others of every tenth vector."""
    return K.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 10 == 0).select("query_id", "rank", "vec_id", F.round("square", 6).alias("square"))


@query("mdl_05_knn", _KNN + ", v AS (SELECT query_id, label, count(*) AS n FROM k GROUP BY ALL) SELECT query_id, arg_max(label, (n, -label)) AS predicted FROM v GROUP BY query_id")
def mdl_05_knn(spark, sf_dir):
    """What most of the ten nearest say."""
    vectors = table(spark, sf_dir, "embeddings")
    return K.voted(K.nearest(vectors, F.col("vec_id") % 10 == 0), vectors)
