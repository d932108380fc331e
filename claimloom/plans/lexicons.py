"""Queries of features and pieces by tables of words; the words of ``benchmark`` stand for lexicons, familiar words and pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import features as X
from claimloom.operators import lexicon as L
from claimloom.operators import wordpiece as P
from claimloom.operators.numbering import numbered
from claimloom.plans.base import query, table

_TOKENS = r"regexp_extract_all(text, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')"
_LOW = "regexp_extract_all(lower(text), '[a-z]+')"


@query(
    "fea_05_lexicon_tables",
    f"""WITH l AS (SELECT DISTINCT 'items ' || (item_id % 9) AS lexicon, unnest({_TOKENS}) AS term FROM benchmark), t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
    h AS (SELECT doc_id, lexicon, count(*) AS k FROM t JOIN l ON l.term = t.term GROUP BY ALL), d AS (SELECT doc_id, len({_TOKENS}) AS n FROM documents), f AS (SELECT DISTINCT lexicon AS feature FROM l)
    SELECT d.doc_id, feature, round(CASE WHEN n > 0 THEN coalesce(k, 0) / n END, 9) AS value FROM d CROSS JOIN f LEFT JOIN h ON h.doc_id = d.doc_id AND h.lexicon = f.feature""",
)
def fea_05(spark, sf_dir):
    """Shares of the tokens of all documents that are in nine lexicons, the tokens of a ninth of the items each."""
    lexicon = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("items "), (F.col("item_id") % 9).cast("string")).alias("lexicon"), F.explode(X.tokens("text")).alias("term"))
    return L.shares(table(spark, sf_dir, "documents"), lexicon).withColumn("value", F.round("value", 9))


@query(
    "fea_10_dale_chall",
    f"""WITH w AS (SELECT doc_id, unnest({_LOW}) AS term FROM documents), k AS (SELECT DISTINCT unnest({_LOW}) AS term FROM benchmark WHERE item_id % 2 = 0),
    n AS (SELECT doc_id, count(*) AS w, count(*) FILTER (k.term IS NULL) AS difficult FROM w LEFT JOIN k ON k.term = w.term GROUP BY doc_id),
    s AS (SELECT doc_id, greatest(1, length(text) - length(regexp_replace(text, '[.!?]', '', 'g'))) AS s FROM documents)
    SELECT doc_id, difficult, round(0.1579 * (100 * difficult / w) + 0.0496 * w / s + CASE WHEN 100 * difficult / w > 5 THEN 3.6365 ELSE 0 END, 6) AS dale_chall FROM n JOIN s USING (doc_id)""",
)
def fea_10_dale_chall(spark, sf_dir):
    """The words of every other item are the familiar ones."""
    familiar = table(spark, sf_dir, "benchmark").filter("item_id % 2 = 0").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    return L.dale_chall(table(spark, sf_dir, "documents"), familiar).withColumn("dale_chall", F.round("dale_chall", 6))


_WORDS = rf"regexp_extract_all(lower(text), '{P.WORD}')"
_PIECES = f"""signs AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^\\s]')) AS s FROM documents), items AS (SELECT DISTINCT unnest({_WORDS}) AS w FROM benchmark WHERE text IS NOT NULL),
    pieces AS (SELECT s AS piece FROM signs WHERE s <> 'q' UNION SELECT '##' || s FROM signs WHERE s <> 'q' UNION SELECT w FROM items UNION SELECT '##' || right(w, 3) FROM items WHERE length(w) > 3),
    vocab AS (SELECT piece, CAST(row_number() OVER (ORDER BY piece) + 3 AS INTEGER) AS id FROM pieces)"""


@query(
    "tok_09_wordpieces",
    f"""WITH RECURSIVE {_PIECES}, placed AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, {_WORDS}[1:382] AS w FROM documents) x, unnest(range(1, len(w) + 1)) AS u(p)), every AS (SELECT DISTINCT word FROM placed WHERE length(word) <= 100),
    places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM every), parts AS (SELECT word, i, unnest(range(1, length(word) - i + 2)) AS n FROM places),
    best AS (SELECT word, i, max(n) AS n, max_by(id, n) AS id FROM parts JOIN vocab ON piece = CASE WHEN i > 1 THEN '##' ELSE '' END || substring(word, i, n) GROUP BY word, i),
    walk AS (SELECT word, 1::BIGINT AS i, []::INTEGER[] AS ids FROM every UNION ALL SELECT w.word, w.i + b.n, list_append(w.ids, b.id) FROM walk w JOIN best b ON b.word = w.word AND b.i = w.i),
    done AS (SELECT word, ids FROM walk WHERE i = length(word) + 1),
    texts AS (SELECT doc_id, flatten(list(coalesce(ids, [1]) ORDER BY p))[1:382] AS ids FROM placed LEFT JOIN done ON done.word = placed.word GROUP BY doc_id),
    whole AS (SELECT d.doc_id, coalesce(t.ids, []) AS ids FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id)
    SELECT doc_id, list_resize([2] || ids || [3], 384, 0) AS ids, CAST(len(ids) + 2 AS INTEGER) AS n_mask FROM whole""",
)
def tok_09(spark, sf_dir):
    """All documents by a vocabulary of the items' words and word ends and of single signs but q: 384 ids and how many are text."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    signs = P.signs(documents).filter("s <> 'q'")
    whole = items.select(F.explode(P.words("text")).alias("w")).distinct()
    forms = signs.select(F.explode(F.array("s", F.concat(F.lit(P.WITHIN), "s"))).alias("piece"))
    ends = whole.filter("length(w) > 3").select(F.concat(F.lit(P.WITHIN), F.expr("right(w, 3)")).alias("piece"))
    pieces = numbered(forms.union(whole.select("w")).union(ends).distinct(), "piece", "n").select("piece", (F.col("n") + 3).cast("int").alias("id"))
    special = spark.createDataFrame([(P.PAD, 0), (P.UNKNOWN, 1), (P.BEGIN, 2), (P.END, 3)], "piece string, id int")
    out = P.encoded(documents, pieces.union(special))
    return out.select("doc_id", "ids", F.size(F.array_remove("mask", 0)).alias("n_mask"))
