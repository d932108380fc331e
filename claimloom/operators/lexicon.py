"""Features by tables of words: lexicons of any size, familiar words, and tables of ready-made category shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import features as X


def shares(rows: DataFrame, lexicon: DataFrame, c: str = "text") -> DataFrame:
    """FEA-04, FEA-05: (doc_id, feature, value): the share of a document's tokens that are in each lexicon (lexicon, term).

    A lexicon is a set of words as they are written; one that a document shares no token with gives 0, a document without
    tokens null. Tokens are counted a document and word before the join and a document and lexicon after it; Spark
    broadcasts the lexicons only if it finds them small. Their names are a list in the plan, a name a feature.
    """
    names = sorted(r[0] for r in lexicon.filter("lexicon IS NOT NULL").select("lexicon").distinct().collect())
    terms = lexicon.filter("lexicon IS NOT NULL AND term IS NOT NULL").select("lexicon", "term").distinct()
    hits = X.lexicon_join(rows.select("doc_id", c), terms, c).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("lexicon", "n"))).alias("_hits"))  # an entry a lexicon
    sized = rows.select("doc_id", F.coalesce(F.size(X.tokens(c)), F.lit(0)).alias("_n"))
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    every = sized.join(hits, "doc_id", "left").select("doc_id", "_n", "_hits", F.explode(listed).alias("feature"))
    found = F.coalesce(F.get(F.map_values(F.map_filter("_hits", lambda k, v: k == F.col("feature"))), F.lit(0)), F.lit(0))
    return every.select("doc_id", "feature", F.try_divide(found.cast("double"), F.col("_n").cast("double")).alias("value"))


def dale_chall(rows: DataFrame, familiar: DataFrame, c: str = "text") -> DataFrame:
    """FEA-10: (doc_id, difficult, dale_chall): words that are not in a table of familiar ones (term), and the score by them.

    Words are runs of a to z in lower case, counted a document and word before the join; documents without words give no row.
    """
    low = F.lower(T.col(c))
    sentences = rows.select("doc_id", F.greatest(F.lit(1), F.regexp_count(low, F.lit("[.!?]"))).cast("double").alias("_s"))
    counted = X.exploded(rows, F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    known = familiar.select(F.lower("term").alias("term")).distinct().withColumn("_known", F.lit(True))
    judged = counted.join(known, "term", "left").groupBy("doc_id").agg(F.sum("n").alias("_w"), F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0)).alias("difficult"))
    percent = 100 * F.col("difficult") / F.col("_w")
    score = 0.1579 * percent + 0.0496 * F.col("_w") / F.col("_s") + F.when(percent > 5, 3.6365).otherwise(0.0)
    return judged.join(sentences, "doc_id").select("doc_id", "difficult", score.alias("dale_chall"))


def ready_made(rows: DataFrame, key: str = "doc_id", by: float = 0.01) -> DataFrame:
    """FEA-06: (doc_id, feature, value) of a table with a column of percentages a category, as shares.

    Every part of the data is scaled alike; cells that are no number are null.
    """
    columns = [c for c in rows.columns if c != key]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"`{c}`").try_cast("double") * by).alias("value")) for c in columns])
    return rows.select(F.col(f"`{key}`").alias("doc_id"), F.explode(cells).alias("x")).select("doc_id", "x.*")
