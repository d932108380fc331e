"""Queries of significance, percentiles, rankings and elimination."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import features as X
from claimloom.operators import significance as S
from claimloom.plans.base import CLASSED, classed, query
from claimloom.plans.learning import _FSCORE, _SURFACE, _TERMS, _idf, _surface_values, _weights

_TERM_F = f"""WITH {CLASSED}, v AS (SELECT doc_id, term AS feature, count(*)::DOUBLE AS value FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM classed) GROUP BY ALL),
 y AS (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS sy, sum(label * label)::DOUBLE AS syy FROM classed), x AS (SELECT feature, sum(value) AS sx, sum(value * value) AS sxx, sum(value * label) AS sxy FROM v JOIN classed USING (doc_id) GROUP BY feature),
 r AS (SELECT feature, n, (n * sxy - sx * sy) ** 2 / nullif((n * sxx - sx * sx) * (n * syy - sy * sy), 0) AS r2 FROM x, y), s AS (SELECT feature, round(r2 * (n - 2) / nullif(1 - r2, 0), 6) AS f FROM r)"""


def _term_scores(spark, sf_dir):
    rows = classed(spark, sf_dir)
    values = X.term_counts(rows).select("doc_id", F.col("term").alias("feature"), F.col("tf").cast("double").alias("value"))
    return X.f_scores(values, rows.select("doc_id", "label")).withColumn("f", F.round("f", 6))


@query("sel_02_p_values")
def sel_02_p_values(spark, sf_dir):
    """F scores of the surface features with their p-values."""
    rows = classed(spark, sf_dir)
    return S.with_p(X.f_scores(_surface_values(rows), rows.select("doc_id", "label")), rows.count())


@query("sel_02_significant", _FSCORE + ", s AS (SELECT feature, round(r * r * (n - 2) / (1 - r * r), 4) AS f FROM a) SELECT feature, f, row_number() OVER (ORDER BY f DESC, feature) AS place FROM s")
def sel_02_significant(spark, sf_dir):
    """The order of p-values, which is that of the F scores."""
    from claimloom.operators.numbering import numbered

    scored = sel_02_p_values(spark, sf_dir).select("feature", F.round("f", 4).alias("f"), "p_value")
    return numbered(scored, ["p_value", F.desc("f"), "feature"], "place").select("feature", "f", F.col("place").cast("long").alias("place"))


@query("sel_02_percentile", _TERM_F + ", t AS (SELECT quantile_cont(f, 0.9) AS t, floor(count(*) * 0.1) AS n FROM (SELECT coalesce(f, -1e308) AS f FROM s)), k AS (SELECT count(*) AS k FROM s, t WHERE f > t) SELECT feature, f FROM s, t WHERE f > t UNION ALL SELECT feature, f FROM (SELECT feature, f, row_number() OVER (ORDER BY feature) AS r FROM s, t WHERE f = t), t, k WHERE r + k <= n")
def sel_02_percentile(spark, sf_dir):
    """The tenth of all terms with the best F scores."""
    return S.best_percentile(_term_scores(spark, sf_dir), 10)


@query("sel_03_elimination")
def sel_03(spark, sf_dir):
    """Ranks of the surface features by recursive elimination."""
    wide = classed(spark, sf_dir).select("label", *[X.surface()[k].cast("double").alias(k) for k in _SURFACE]).persist()
    ranks = S.eliminated(S.standardised(wide, list(_SURFACE)), list(_SURFACE))
    wide.unpersist()
    return spark.createDataFrame(ranks, "feature string, rank int, steps int")  # a row a feature


@query("sel_06_report")
def sel_06_report(spark, sf_dir):
    """Feature, mean of true and of false documents, p-value, ratio false to true."""
    from claimloom.plans.learning import sel_06

    p = sel_02_p_values(spark, sf_dir).select("feature", "p_value")
    return sel_06(spark, sf_dir).drop("f").join(p, "feature")


_SPARSE = f"WITH {CLASSED}, {_idf('classed')}, g AS (SELECT 'all' AS class, term, round(idf, 6) AS score FROM idf), w AS (SELECT doc_id, term, round(weight, 6) AS weight FROM weights WHERE round(weight, 6) >= 0.1), z AS (SELECT label, count(*) AS n FROM classed GROUP BY label), m AS (SELECT c.label::VARCHAR AS class, term, round(sum(weight) / any_value(z.n), 6) AS score FROM w JOIN classed c ON c.doc_id = w.doc_id JOIN z ON z.label = c.label GROUP BY ALL), u AS (SELECT * FROM g UNION ALL SELECT * FROM m) SELECT class, term, score, row_number() OVER (PARTITION BY class ORDER BY score DESC, term) AS place FROM u QUALIFY place <= 10"


@query("sel_07_sparse_ranking", _SPARSE)
def sel_07(spark, sf_dir):
    """The ten terms of the highest idf, and the ten of the largest mean weight of each class."""
    rows = classed(spark, sf_dir).select("doc_id", "text", "label")
    idf = X.fit_idf(X.term_counts(rows), rows.count(), 2, 0.5).select("term", F.round("idf", 6).alias("score"))
    top = idf.orderBy(F.desc("score"), "term").limit(10)
    from pyspark.sql import Window

    first = top.select(F.lit("all").alias("class"), "term", "score", F.row_number().over(Window.orderBy(F.desc("score"), "term")).cast("long").alias("place"))  # ten rows
    weights = _weights(rows.select("doc_id", "text")).select("doc_id", "term", F.round("weight", 6).alias("weight"))
    by = X.top_by_class(weights, rows.select("doc_id", "label"), 10)
    return first.unionByName(by.select(F.col("label").cast("string").alias("class"), "term", F.col("mean_weight").alias("score"), F.col("place").cast("long").alias("place")))
