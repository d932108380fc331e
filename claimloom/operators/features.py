"""Tokens, document features and TF-IDF, in long form (doc_id, term or feature, value)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators.storage import written
from claimloom.resources.words import LEXICONS, STOP_WORDS, TAG_ENDINGS, TAG_WORDS, TAGS

TOKEN = "[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]"
TERM = "[a-z0-9_]{2,}"
#: Distinct tokens whose tags a task remembers at once.
REMEMBERED = 100_000
VOWELS, CONSONANTS = "aeiouy", "b-df-hj-np-tv-xz"
PUNCTUATION = r"[^!-/:-@\[-`{-~]"


def tokens(c) -> Column:
    """TOK-02: runs of letters and digits, other signs alone (contractions are not parted as a treebank would)."""
    return F.regexp_extract_all(T.col(c), F.lit(TOKEN), F.lit(0))


def terms(c, stop: bool = True) -> Column:
    """TOK-03: lower-case words of two signs or more, without stop words."""
    found = F.regexp_extract_all(F.lower(T.col(c)), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if stop else found


def ngrams(c: Column, low: int, high: int) -> Column:
    """TOK-04: all n-grams of an array of words, which is computed once; an n-gram is the one before it and a word."""

    def every(w: Column) -> Column:
        held, grams = [], w
        for n in range(1, high + 1):
            if n > 1:
                size = F.greatest(F.size(w) - n + 1, F.lit(0))
                grams = F.zip_with(F.slice(grams, F.lit(1), size), F.slice(w, F.lit(n), size), lambda a, b: F.concat(a, F.lit(" "), b))
            if n >= low:
                held.append(grams)
        return F.concat(*held)

    return F.get(F.transform(F.array(c), every), F.lit(0))


def sentences(c) -> Column:
    """TOK-05: parts between full stops that are not blank."""
    return F.filter(F.transform(F.split(T.col(c), "[.]"), lambda s: F.trim(s)), lambda s: s != "")


def exploded(rows: DataFrame, array: Column, name: str = "term") -> DataFrame:
    return rows.select("doc_id", F.explode(array).alias(name))


def vocabulary(rows: DataFrame, c: str = "text", most: int | None = 20000) -> DataFrame:
    """TOK-06: (term, id): ids from 1 by falling count, ties by term; all terms, or without ids from ``most`` on, as 0 is for padding."""
    counts = exploded(rows, terms(c, stop=False)).groupBy("term").agg(F.count("*").alias("n"))
    if most is None:
        from claimloom.operators.numbering import numbered

        return numbered(counts.select("term", (-F.col("n")).alias("_n")), ["_n", "term"], "id").select("term", F.col("id").cast("int").alias("id"))
    top = counts.orderBy(F.desc("n"), "term").limit(most - 1)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "term"))).select("term", "id")


def id_sequences(rows: DataFrame, vocab: DataFrame, c: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of the known terms in order."""
    at = rows.select("doc_id", F.posexplode(terms(c, stop=False)).alias("p", "term"))
    found = at.join(vocab, "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", "id"))).alias("s"))
    known = found.select("doc_id", F.transform("s", lambda x: x.id).alias("ids"))
    return rows.select("doc_id").join(known, "doc_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def padded(c, n: int, side: str = "post") -> Column:
    """TOK-07: cut and filled with 0 to n ids, at the end or (``pre``) the beginning."""
    c = T.col(c)
    fill = F.array_repeat(F.lit(0), F.greatest(F.lit(0), n - F.size(c)))
    if side == "post":
        return F.concat(F.slice(c, 1, n), fill)
    return F.concat(fill, F.when(F.size(c) > n, F.slice(c, F.size(c) - n + 1, n)).otherwise(c))


def hierarchical(c, n_sentences: int = 15, n_words: int = 100) -> Column:
    """TOK-08: words of the first sentences, '' as filling."""
    rows = F.transform(F.slice(sentences(c), 1, n_sentences), lambda s: F.slice(F.concat(T.words(s), F.array_repeat(F.lit(""), n_words)), 1, n_words))
    empty = F.array_repeat(F.array_repeat(F.lit(""), n_words), n_sentences)
    return F.slice(F.concat(rows, empty), 1, n_sentences)


def bag_of_words(rows: DataFrame, c: str = "text", drop_top: int = 100, no_below: int = 5, no_above: float = 0.5) -> DataFrame:
    """TOK-10: (doc_id, term, n) without the most frequent terms, then without rare and common ones."""
    counted = exploded(by_document(rows, c), terms(c, stop=False)).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    n_docs = rows.agg(F.count("*").alias("n_docs"))
    top = df.orderBy(F.desc("df"), "term").limit(drop_top).select("term")
    kept = df.join(F.broadcast(top), "term", "left_anti").crossJoin(F.broadcast(n_docs))  # at most drop_top rows; one row
    kept = kept.filter((F.col("df") >= no_below) & (F.col("df") <= no_above * F.col("n_docs"))).select("term")
    return counted.join(bounded(kept), "term")


def surface(c="text") -> dict[str, Column]:
    """FEA-01 to FEA-03."""
    s = T.col(c)
    n_char, n_sentence = F.length(s), F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    n_punc = F.length(F.regexp_replace(s, PUNCTUATION, ""))
    split = T.words(s)
    n_upper = F.regexp_count(s, F.lit(r"(?<!\S)[^\s\p{Ll}]*\p{Lu}[^\s\p{Ll}]*(?!\S)"))  # a capital and no small letter
    n_word = F.size(split)
    return {
        "num_char": n_char, "num_sentence": n_sentence, "num_punc": n_punc, "num_upper": n_upper, "num_word": n_word,
        "punc_ratio": n_punc / (n_char + 1), "upper_ratio": n_upper / (n_char + 1), "words_per_sentence": n_word / (n_sentence + 1),
    }


def lexicon_ratios(rows: DataFrame, lexicons: dict[str, list[str]] = LEXICONS, c: str = "text") -> DataFrame:
    """FEA-04, FEA-05: (doc_id, feature, value): the share of tokens that are in each lexicon; null without tokens.

    The words of a lexicon are a literal of the plan, so that no token leaves its row.
    """
    split = tokens(c)
    held = rows.select("doc_id", split.alias("_t"))
    shares = [F.struct(F.lit(name).alias("feature"), F.try_divide(_count_in("_t", words), F.size("_t").cast("double")).alias("value")) for name, words in sorted(lexicons.items())]
    return held.select("doc_id", F.explode(F.array(*shares)).alias("x")).select("doc_id", "x.*")


def _count_in(c: str, words) -> Column:
    listed = list(words)
    return F.size(F.filter(c, lambda t: t.isin(listed)))


def lexicon_join(rows: DataFrame, lexicon: DataFrame, c: str = "text") -> DataFrame:
    """JON-08: (doc_id, lexicon, n): tokens that are in a lexicon table (lexicon, term).

    A lexicon that is broadcast meets the tokens where they are found, so only counts a document and lexicon are shuffled;
    a larger one meets tokens counted a document and word.
    """
    held = written(lexicon)
    found = exploded(rows, tokens(c))
    if held.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(held), "term").groupBy("doc_id", "lexicon").agg(F.count("*").alias("n"))
    counted = found.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return counted.join(held, "term").groupBy("doc_id", "lexicon").agg(F.sum("n").alias("n"))


class Tags(dict):
    """FEA-07: the tags of tokens, found as they are asked for: by word list, then by ending (no tagger is at hand; another mapping can take its place)."""

    def __missing__(self, token: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = out = self.tag(token)
        return out

    @staticmethod
    def tag(token: str) -> str:
        if not token.isascii() or not re.search("[A-Za-z0-9_]", token):
            return "."
        if token.isdigit():
            return "NUM"
        low = token.lower()
        listed = (name for name, words in TAG_WORDS.items() if low in words)
        ended = (name for ending, name in TAG_ENDINGS if low.endswith(ending))
        return next(listed, None) or next(ended, "X")


def tag_counts(rows: DataFrame, c: str = "text") -> DataFrame:
    """FEA-07, FEA-08: (doc_id, tag, n, ratio) with one added to each tag's count; null for a null text.

    A token's tag is looked up in its task: as an expression it was told anew for each token, most of the time of the query.
    """
    names = sorted(TAGS)
    pattern = re.compile(TOKEN, re.ASCII)  # white space as in ``tokens``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tags()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [None if text is None else Counter(map(known.__getitem__, pattern.findall(text))) for text in part.column(1).to_pylist()]
                counts = pa.array([None if n is None else [n[t] for t in names] for n in found], pa.list_(pa.int32()))
                totals = pa.array([None if n is None else n.total() for n in found], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), totals, counts], ["doc_id", "_n", "_c"])

    tagged = rows.select("doc_id", c).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, _n int, _c array<int>")
    each = F.array(*[F.struct(F.lit(t).alias("tag"), (F.get("_c", F.lit(k)) + 1).alias("n")) for k, t in enumerate(names)])
    long = tagged.select("doc_id", "_n", F.explode(each).alias("x"))
    return long.select("doc_id", "x.tag", "x.n", (F.col("x.n") / (F.col("_n") + len(TAGS))).alias("ratio"))


def readability(c="text") -> dict[str, Column]:
    """FEA-10: closed forms over letters, words, sentences and syllables; null without words.

    A word's syllables are its groups of vowels, at least one. No group crosses words, so all are counted over the whole text:
    groups, words without a vowel, and hard words, which have three groups.
    """
    s = F.lower(T.col(c))
    count = lambda pattern: F.regexp_count(s, F.lit(pattern)).cast("double")
    words = count("[a-z]+")
    letters = F.length(F.regexp_replace(s, "[^a-z]+", "")).cast("double")
    n_sentences = F.greatest(F.lit(1.0), count("[.!?]"))
    syllables = count(f"[{VOWELS}]+") + count(f"(?<![a-z])[{CONSONANTS}]++(?![a-z])")
    hard = count(f"(?<![a-z])(?:[{CONSONANTS}]*+[{VOWELS}]++){{3}}[a-z]*+")
    per_sentence, per_word = F.try_divide(words, n_sentences), F.try_divide(syllables, words)
    easy = F.try_divide(hard * 3 + (words - hard), n_sentences)
    return {
        "flesch": 206.835 - 1.015 * per_sentence - 84.6 * per_word,
        "smog": 1.043 * F.sqrt(hard * F.try_divide(F.lit(30.0), n_sentences)) + 3.1291,
        "kincaid": 0.39 * per_sentence + 11.8 * per_word - 15.59,
        "coleman_liau": 0.0588 * F.try_divide(letters * 100, words) - 0.296 * F.try_divide(n_sentences * 100, words) - 15.8,
        "ari": 4.71 * F.try_divide(letters, words) + 0.5 * per_sentence - 21.43,
        "linsear": F.when(easy > 20, easy / 2).otherwise((easy - 2) / 2),
        "fog": 0.4 * (per_sentence + 100 * F.try_divide(hard, words)),
    }


def embedding_sum(rows: DataFrame, vectors: DataFrame, c: str = "text") -> DataFrame:
    """FEA-11: (doc_id, dim, value): the normalised sum of the known terms' vectors (term, vector)."""
    vectors = written(vectors.select("term", F.col("vector").cast("array<double>").alias("vector")))
    n, dims = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    known = F.broadcast(vectors) if n * (dims or 0) <= 8 * BROADCAST_ROWS else vectors
    found = term_counts(rows, c).join(known, "term")
    sums = [F.sum(F.get("vector", F.lit(k)) * F.col("tf")).alias(f"_{k}") for k in range(dims or 0)]  # a document's, side by side
    summed = found.groupBy("doc_id").agg(F.max(F.size("vector")).alias("_d"), *sums)
    norm = F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))
    whole = summed.select("doc_id", F.slice(F.array(*[f"_{k}" for k in range(dims or 0)]).cast("array<double>"), F.lit(1), F.greatest("_d", F.lit(0))).alias("_s"))
    return whole.withColumn("_n", norm).select("doc_id", "_n", F.posexplode("_s").alias("dim", "s")).select("doc_id", "dim", F.try_divide("s", "_n").alias("value"))


def union_weighted(blocks: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """FEA-15, FEA-16: (doc_id, feature, value) of all blocks times their weights; blocks of weight 0 are not computed."""
    out = None
    for name, (rows, weight) in blocks.items():
        if weight:
            part = rows.select("doc_id", F.concat(F.lit(f"{name}:"), F.col("feature").cast("string")).alias("feature"), (F.col("value") * weight).alias("value"))
            out = part if out is None else out.unionByName(part)
    return out


def ensemble(blocks: dict[str, DataFrame]) -> DataFrame:
    """FEA-13, FEA-14: (doc_id, feature, value) of all blocks side by side, without documents on which a block failed.

    A block fails on a document by a null value or by no row.
    """
    parts = [rows.select("doc_id", F.lit(name).alias("_block"), F.concat(F.lit(f"{name}:"), F.col("feature").cast("string")).alias("feature"), "value") for name, rows in blocks.items()]
    every = reduce(DataFrame.unionByName, parts)
    whole = every.groupBy("doc_id").agg(F.count_distinct("_block").alias("_b"), F.count_if(F.col("value").isNull()).alias("_failed"))
    whole = whole.filter((F.col("_b") == len(blocks)) & (F.col("_failed") == 0))
    return every.drop("_block").join(whole.select("doc_id"), "doc_id", "left_semi")


def with_unknown(terms: DataFrame, vectors: DataFrame, dims: int, seed: int = 0) -> DataFrame:
    """JON-09: (term, known, vector) of each term; one without a vector gets numbers in [-1, 1) from a hash of term, place and seed."""
    part = lambda i: F.substring(F.md5(F.concat_ws("-", "term", i.cast("string"), F.lit(str(seed)))), 1, 8)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(part(i), 16, 10).cast("double") / float(1 << 31) - 1)
    joined = terms.select("term").join(vectors.select("term", "vector"), "term", "left")
    return joined.select("term", F.col("vector").isNotNull().alias("known"), F.coalesce(F.col("vector").cast("array<double>"), drawn).alias("vector"))


def unpivoted(rows: DataFrame, features: dict[str, Column]) -> DataFrame:
    """(doc_id, feature, value) of Column features."""
    each = F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value")) for k, v in features.items()])
    return rows.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")


def by_document(rows: DataFrame, c: str = "text") -> DataFrame:
    """``rows`` (doc_id, text) dealt by document, so that what is counted within one shuffles no row a word."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, so that few large ones are not made of them
    return rows.select("doc_id", c).repartition(parts, "doc_id")


#: Rows that are broadcast at most; beyond, the same join shuffles, with the same result.
BROADCAST_ROWS = 1_000_000


def bounded(table: DataFrame) -> DataFrame:
    """``table`` computed once, marked for broadcast if its checked number of rows allows."""
    held = written(table)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def term_counts(rows: DataFrame, c: str = "text", low: int = 1, high: int = 1) -> DataFrame:
    return exploded(by_document(rows, c), ngrams(terms(c), low, high)).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def fit_idf(counts: DataFrame, n_docs: int | Column, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """TFI-01, fit: (term, idf) of the terms whose document frequency is allowed; idf = ln((1 + n) / (1 + df)) + 1."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    df = counts.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return df.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"), "df")


def tfidf(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """TFI-02: (doc_id, term, weight): (1 + ln tf) * idf, normalised by document."""
    raw = counts.join(bounded(idf), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / norm).alias("weight"))


def hashed(counts: DataFrame, n: int = 1 << 16) -> DataFrame:
    """TFI-03: (doc_id, slot, tf)."""
    slot = F.pmod(F.hash("term"), F.lit(n))
    return counts.groupBy("doc_id", slot.alias("slot")).agg(F.sum("tf").alias("tf"))


def top_by_document(weights: DataFrame, n: int) -> DataFrame:
    """TFI-05."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return weights.withColumn("place", place).filter(F.col("place") <= n)


def top_by_class(weights: DataFrame, labels: DataFrame, n: int, least: float = 0.1, digits: int = 6) -> DataFrame:
    """TFI-06, TFI-07: each class's terms with the largest mean weight over all its documents; small weights count 0.

    Means are rounded before they are ranked, so that the order of a sum does not decide a tie.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("_n"))
    summed = weights.filter(F.col("weight") >= least).join(labels, "doc_id").groupBy("label", "term").agg(F.sum("weight").alias("_s"))
    means = summed.join(F.broadcast(sizes), "label").select("label", "term", F.round(F.col("_s") / F.col("_n"), digits).alias("mean_weight"))  # a row a class
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("mean_weight"), "term"))
    return means.withColumn("place", place).filter(F.col("place") <= n)


def chi2(values: DataFrame, labels: DataFrame) -> DataFrame:
    """SEL-01: (feature, chi2) of non-negative features (doc_id, feature, value) by class."""
    by_class = labels.groupBy("label").agg(F.count("*").alias("_n"))
    share = by_class.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy()))
    observed = values.join(labels, "doc_id").groupBy("feature", "label").agg(F.sum("value").alias("_o"))
    total = observed.groupBy("feature").agg(F.sum("_o").alias("_t"))
    every = total.crossJoin(F.broadcast(share.select("label", "_p")))  # a row a class
    both = every.join(observed, ["feature", "label"], "left").withColumn("_e", F.col("_t") * F.col("_p"))
    gap = F.coalesce("_o", F.lit(0.0)) - F.col("_e")
    return both.groupBy("feature").agg(F.sum(F.try_divide(gap * gap, F.col("_e"))).alias("chi2"))


def f_scores(values: DataFrame, labels: DataFrame) -> DataFrame:
    """SEL-02: (feature, f): F of the correlation of a feature (0 where a document has none) with the label."""
    y = labels.select(F.count("*").alias("n"), F.sum("label").alias("sy"), F.sum(F.col("label") * F.col("label")).alias("syy"))
    x = values.join(labels, "doc_id").groupBy("feature").agg(F.sum("value").alias("sx"), F.sum(F.col("value") * F.col("value")).alias("sxx"), F.sum(F.col("value") * F.col("label")).alias("sxy"))
    both = x.crossJoin(F.broadcast(y))  # one row
    n = F.col("n").cast("double")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    r2 = F.try_divide(cov * cov, (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    return both.select("feature", F.try_divide(r2 * (n - 2), 1 - r2).alias("f"))
