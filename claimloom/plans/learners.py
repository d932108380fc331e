"""Queries of learners by mistakes and of reduced features."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import mistakes as L
from claimloom.operators import reduction, sparse
from claimloom.plans.base import articles, query, table

LEARNERS = [L.Learner("perceptron", "perceptron"), L.Learner("passive-aggressive", "passive"), L.Learner("hinge", "hinge")]


@query("mdl_02_mistake_driven")
def mdl_02(spark, sf_dir):
    """What a perceptron, a passive-aggressive and a stochastic hinge learner say of a held-out fifth's toxicity, which words tell."""
    texts = articles(spark, sf_dir).select("doc_id", "text", F.col("toxic").alias("label"))
    rows, terms = sparse.weighted(texts)
    labelled = rows.join(texts.select("doc_id", "label"), "doc_id")
    weights, _ = L.fit(labelled.filter("doc_id % 5 <> 0"), len(terms), LEARNERS)
    held = rows.filter("doc_id % 5 = 0")
    return L.decided(held, weights, LEARNERS).join(texts.select("doc_id", "label"), "doc_id").select("doc_id", "learner", "label", "predicted", F.round("decision", 6).alias("decision"))


@query("sel_09_components")
def sel_09(spark, sf_dir):
    """All documents on the ten directions of the largest singular values of their term weights."""
    rows, terms = sparse.weighted(table(spark, sf_dir, "documents"), min_df=5, max_df=0.5)
    return reduction.projected(rows, reduction.decomposed(rows, len(terms)))
