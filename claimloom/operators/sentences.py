"""Sentences by abbreviations that the corpus itself shows (unsupervised, after Kiss and Strunk).

A word that stands before a period far more often than words do is an
abbreviation: a likelihood ratio against the share of words with a period,
weighted for short words, inner periods and few places without a period.  One
aggregation counts all words; a splitter then joins the abbreviations to the
words that stand before a period.

A null text has no words and no sentences.  ``rows`` have one text a doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T

#: A word of letters, digits and inner periods; with the period that follows it.
WORD = r"[\p{L}\p{N}]+(?:[.][\p{L}\p{N}]+)*"
#: The last word of a run of signs that ends with a period and closing signs; a run that ends as sentences do.
BEFORE_PERIOD = f"({WORD})" + r"[.][\"')\]]*$"
ENDS = r"[.?!][\"')\]]*$"
#: From this ratio on a word is an abbreviation; the share of periods behind abbreviations that is held against the corpus's.
LEAST, SURE = 0.3, 0.99


def period_counts(rows: DataFrame, c: str = "text") -> DataFrame:
    """(term, with_period, without): how often each lower-case word has a period behind it."""
    found = rows.select(F.explode(F.regexp_extract_all(F.lower(T.col(c)), F.lit(f"{WORD}[.]?"), F.lit(0))).alias("w"))
    ends = F.endswith("w", F.lit("."))
    each = found.select(F.when(ends, F.expr("substr(w, 1, length(w) - 1)")).otherwise(F.col("w")).alias("term"), ends.alias("e"))
    return each.groupBy("term").agg(F.count_if("e").alias("with_period"), F.count_if(~F.col("e")).alias("without"))


def abbreviations(counts: DataFrame, least: float = LEAST) -> DataFrame:
    """TOK-05: (term, with_period, without, score, abbreviation) of all words with a letter that once have a period."""
    totals = counts.agg(F.sum(F.col("with_period") + F.col("without")).alias("_all"), F.sum("with_period").alias("_periods"))  # one row
    share = F.col("_periods") / F.col("_all")
    rest = F.greatest(1 - share, F.lit(1e-12))
    a, b = F.col("with_period"), F.col("without")
    ratio = -2 * (a * (F.log(share) - F.log(F.lit(SURE))) + b * (F.log(rest) - F.log(F.lit(1 - SURE))))
    inner = F.length("term") - F.length(F.replace("term", F.lit("."), F.lit("")))
    signs = F.length("term") - inner
    score = ratio * F.exp(-signs.cast("double")) * (inner + 1) * F.pow(signs.cast("double"), -b.cast("double"))
    held = counts.filter((F.col("with_period") > 0) & F.rlike("term", F.lit(r"\p{L}"))).crossJoin(F.broadcast(totals))
    return held.select("term", "with_period", "without", score.alias("score"), (score >= least).alias("abbreviation"))


def _followed(words: Column) -> Column:
    """Places (from 1) of words that end as sentences do and are not followed by a lower-case letter."""
    places = F.transform(words, lambda w, i: F.struct((i + 1).alias("place"), w.alias("word"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("next")))
    return F.filter(places, lambda x: F.rlike(x["word"], F.lit(ENDS)) & ~F.rlike(x["next"], F.lit(r"^[\"'(\[]*\p{Ll}")))


def split(rows: DataFrame, terms: DataFrame, c: str = "text") -> DataFrame:
    """TOK-05: (doc_id, sentences): parts between words that end a sentence; abbreviations (``terms``, a column term) and initials do not."""
    words = F.coalesce(T.words(c), F.array().cast("array<string>"))
    held = rows.select("doc_id", words.alias("words"))
    seen = held.select("doc_id", F.inline(_followed(F.col("words"))))
    last = F.regexp_extract(F.lower("word"), BEFORE_PERIOD, 1)
    ends = seen.select("doc_id", "place", last.alias("term")).filter(~F.rlike("term", F.lit(r"^\p{L}$"))).join(terms.select("term").distinct(), "term", "left_anti")
    by = ends.groupBy("doc_id").agg(F.array_sort(F.collect_list("place")).alias("ends"))  # of a document
    n = F.size("words")
    found = F.coalesce("ends", F.array().cast("array<int>"))
    every = F.when(n == 0, F.array().cast("array<int>")).when(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0)) == n, found).otherwise(F.concat(found, F.array(n)))
    joined = held.join(by, "doc_id", "left").select("doc_id", "words", every.alias("ends"))
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1))
    return joined.select("doc_id", F.transform("ends", lambda e, i: F.array_join(F.slice("words", begin(i) + 1, e - begin(i)), " ")).alias("sentences"))
