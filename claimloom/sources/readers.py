"""Sources: delimited files, folders of texts, lexicons, vectors; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import web as W
from claimloom.operators import features as X
from claimloom.operators import relational as R

#: Layouts of the labelled corpora (fixed values): separator, header, encoding, columns, text, label, label maps.
CORPORA = {
    "imdb": dict(sep="\t", header=True, encoding="UTF-8", columns="id string, sentiment string, review string", text="review", label="sentiment", binary=None),
    "liar": dict(sep="\t", header=False, encoding="UTF-8", columns="id string, label string, data string", text="data", label="label", binary="liar"),
    "combined": dict(sep="\t", header=False, encoding="UTF-8", columns="id string, url string, label string, data string, domain string, source string", text="data", label="label", binary="combined"),
    "rashkin": dict(sep="\t", header=False, encoding="UTF-8", columns="label string, data string", text="data", label="label", binary="rashkin"),
    "buzzfeed": dict(sep="\t", header=False, encoding="UTF-8", columns="ID string, URL string, label string, data string, domain string, source string", text="data", label="label", binary="buzzfeed"),
    "snopes": dict(sep=",", header=True, encoding="UTF-8", columns=None, text="data", label="label", binary="snopes"),
    "snopes312": dict(sep=",", header=True, encoding="ISO-8859-1", columns=None, text="original_article_text_phase2", label="fact_rating_phase1", binary="snopes312"),
    "buzzfeed_top": dict(sep=",", header=True, encoding="ISO-8859-1", columns=None, text="original_article_text_phase2", label=None, binary=None),
    "emergent": dict(sep=",", header=True, encoding="ISO-8859-1", columns=None, text="articleBody", label="claimTruthiness", binary="emergent"),
    "perez": dict(sep=",", header=True, encoding="ISO-8859-1", columns=None, text="text", label="label", binary="perez"),
}
#: Columns of the site tables (fixed values); phase 2 adds the last five.
SITES = {
    "snopes": "fact_rating_phase1 snopes_url_phase1 article_title_phase1 article_category_phase1 article_date_phase1 article_claim_phase1 article_origin_url_phase1 index_paragraph_phase1 page_is_first_citation_phase1".split(),
    "politifact": "politifact_url_phase1 fact_tag_phase1 article_title_phase1 article_claim_phase1 article_claim_citation_phase1 article_published_date_phase1 article_researched_by_phase1 article_edited_by_phase1 article_categories_phase1 original_url_phase1 page_is_first_citation_phase1".split(),
    "emergent": "emergent_url_phase1 fact_tag_phase1 claim_category_phase1 claim_description_phase1 claim_tags_phase1 article_date_phase1 claim_title_phase1 claim_body_phase1 original_url_phase1".split(),
}
PHASE2 = "error_phase2 original_article_text_phase2 article_title_phase2 publish_date_phase2 author_phase2".split()


def csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """SRC-01, SRC-02: delimited text; with a header and no schema all columns are strings."""
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", encoding).option("escape", '"').option("multiLine", True)
    if schema:
        reader = reader.schema(schema).option("enforceSchema", True)
    return reader.csv(path)


def corpus(spark: SparkSession, name: str, path: str, classes: int = 2, strict: bool = False) -> DataFrame:
    """SRC-03 to SRC-12: (doc_id, text, label) of a labelled corpus, cleaned.

    doc_id is the row's place, numbered over the files' parts, since the files have no key of their own.
    """
    c = CORPORA[name]
    rows = csv(spark, path, c["columns"], c["header"], c["sep"], c["encoding"])
    if name == "snopes312":
        rows = rows.filter(F.col("assessment") == "right")
    if name == "emergent":
        rows = rows.withColumn("_o", F.monotonically_increasing_id())
        ignored = [x for x in ("_o", "articleId", "articleVersion", "articleVersionId", "articleUrl", "articleByline") if x in rows.columns]
        rows = R.keep_first_but(rows, ignored, "_o", last=True).drop("_o")
        rows = rows.filter(F.col("articleBody").isNotNull() & (F.col("articleBody") != "") & (F.col("articleStance") == "for"))
    if c["label"] is None:
        label = F.lit(1)
    elif c["binary"] is None:
        label = F.col(c["label"]).cast("int")
    else:
        maps = R.BINARY if classes == 2 else R.FINE
        label = R.recode(F.lower(F.trim(c["label"])) if name in ("snopes312", "emergent", "buzzfeed") else F.col(c["label"]), maps[c["binary"]], strict)
    text = T.clean_str(c["text"])
    return rows.select(F.monotonically_increasing_id().alias("doc_id"), text.alias("text"), label.alias("label"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-13: (name, text), a row a file."""
    return spark.read.text(folder, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("text"))


def stories(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-14: news stories in one line, without the marks of highlights."""
    return texts(spark, folder).withColumn("text", F.regexp_replace(F.replace("text", F.lit("@highlight"), F.lit("")), "\n", " "))


def fixed_width(spark: SparkSession, path: str, label_width: int = 1) -> DataFrame:
    """SRC-16: (label, text) of lines that begin with a label."""
    rows = spark.read.text(path)
    return rows.select(F.substring("value", 1, label_width).alias("label"), F.regexp_replace(F.expr(f"substring(value, {label_width + 1})"), r'^[\s"]+|[\s"]+$', "").alias("text"))


def lexicons(spark: SparkSession, folder: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """SRC-18: (lexicon, term), a lexicon a file of words, parted into tokens as texts are; comment lines (#) are left out."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", encoding).alias("text"))
    rows = files.select(F.regexp_replace("name", r"\.txt$", "").alias("lexicon"), F.explode(F.split("text", r"\r?\n")).alias("line"))
    return rows.filter(~F.col("line").startswith("#")).select("lexicon", F.explode(X.tokens("line")).alias("term")).distinct()


def category_matrix(rows: DataFrame, word: str = "Source (A)", drop: tuple = ("WC", "Analytic", "Clout", "Authentic", "Tone", "WPS")) -> DataFrame:
    """SRC-19: (lexicon, term) of the positive cells of a word by category matrix."""
    categories = [c for c in rows.columns if c not in (word, *drop)]
    long = rows.unpivot([word], [F.col(f"`{c}`").cast("double").alias(c) for c in categories], "lexicon", "v")
    return long.filter(F.col("v") > 0).select("lexicon", F.col(f"`{word}`").alias("term"))


def vectors(spark: SparkSession, path: str, n: int) -> DataFrame:
    """SRC-20: (term, vector) of lines of a word and n numbers."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == n + 1)
    return rows.select(F.col("p")[0].alias("term"), F.transform(F.slice("p", 2, n), lambda x: x.cast("float")).alias("vector"))


def article(pages: DataFrame) -> DataFrame:
    """SRC-23: (page_id, title, text, error) of downloaded pages."""
    body = F.regexp_extract("html", r"(?s)<article[^>]*>(.*?)</article>", 1)
    rows = pages.select("page_id", "url", W.get_text(W.inner("html", "title")).alias("title"), W.get_text(F.when(body != "", body).otherwise(F.col("html"))).alias("text"))
    return rows.select("page_id", "title", "text", W.article_status("text", "url").alias("error"))


def landed(pages: DataFrame, site: str | Column) -> DataFrame:
    """SRC-24: the links of a site's pages that stay on the site, a row a link; the crawler lands the pages."""
    host = W.netloc("url")
    rows = pages.withColumn("_host", host)
    rows = rows.filter(F.contains("_host", F.lit(site) if isinstance(site, str) else site))
    return rows.select("page_id", F.explode(W.anchors("html")).alias("href"), "_host").filter(F.col("href").startswith("/") | F.contains("href", F.col("_host"))).select("page_id", "href")


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """SNK-01, SNK-02, SNK-06: one write with a header."""
    rows.write.mode(mode).option("header", True).option("escape", '"').option("compression", compression or "none").csv(path)


def snapshot(rows: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """SNK-03, SRC-17: a named Parquet snapshot, read back."""
    rows.write.mode(mode).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """SNK-04."""
    vocab.select(F.concat_ws("\t", "id", "term")).write.mode("overwrite").text(path)


def as_json(rows: DataFrame) -> DataFrame:
    """SNK-10."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def merged(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """SNK-07, INC-02: the old rows under the new header; of rows with one key the newest stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    numbered = both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order))))
    return numbered.filter("_r = 1").drop("_r", "_new")
