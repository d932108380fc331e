"""Queries that write given tables in a source's layout and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimloom.operators import relational as R
from claimloom.operators.storage import shared_folder
from claimloom.plans.base import ARTICLES, articles, query, table
from claimloom.sources import readers, vector_files


@query("src_20_vector_files", "SELECT CAST(vec_id AS VARCHAR) AS term, CAST(len(embedding) AS INTEGER) AS dims, embedding[1]::DOUBLE AS first_number, embedding[len(embedding)]::DOUBLE AS last_number, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings WHERE embedding IS NOT NULL")
def src_20(spark, sf_dir):
    """All vectors, written in the binary layout and read in ranges of a megabyte."""
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vector_files.registered(spark)
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL")
    rows.select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").cast("array<float>").alias("vector")).write.format("vector_files").mode("append").save(path)
    back = spark.read.format("vector_files").option("split_bytes", 1 << 20).load(path)
    numbers = F.transform("vector", lambda x: x.cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return back.select("term", F.size("vector").alias("dims"), F.get(numbers, F.lit(0)).alias("first_number"), F.element_at(numbers, -1).alias("last_number"), F.round(total, 5).alias("total"))


#: How the four verdicts are written in each corpus.
WRITTEN = {
    "imdb": {"ftrue": "1", "mixture": "1", "mfalse": "0", "ffalse": "0"},
    "liar": {"ftrue": "true", "mixture": "half-true", "mfalse": "barely-true", "ffalse": "pants-fire"},
    "combined": {"ftrue": "ftrue", "mixture": "mixture", "mfalse": "mfalse", "ffalse": "ffalse"},
    "rashkin": {"ftrue": "4", "mixture": "3", "mfalse": "2", "ffalse": "1"},
    "buzzfeed": {"ftrue": "mostly true", "mixture": "mixture of true and false", "mfalse": "mostly false", "ffalse": "no factual content"},
    "snopes": {"ftrue": "ftrue", "mixture": "mixture", "mfalse": "mfalse", "ffalse": "ffalse"},
    "snopes312": {"ftrue": "True", "mixture": "mixture", "mfalse": "mostly false", "ffalse": "False "},
    "buzzfeed_top": {"ftrue": "", "mixture": "", "mfalse": "", "ffalse": ""},
    "emergent": {"ftrue": "true", "mixture": "unknown", "mfalse": "false", "ffalse": "false"},
    "perez": {"ftrue": "legit", "mixture": "legit", "mfalse": "fake", "ffalse": "fake"},
}
#: Further columns of a layout that its loader reads: name, Spark expression; and which rows the loader keeps by them, in SQL.
BESIDE = {
    "snopes312": ({"assessment": "if(doc_id % 3 = 0, 'wrong', 'right')"}, "doc_id % 3 <> 0"),
    "emergent": ({"articleId": "doc_id", "articleStance": "if(doc_id % 4 = 0, 'against', 'for')"}, "doc_id % 4 <> 0"),
}


def _laid_out(rows, name: str, path: str) -> None:
    """Articles written as the files of a corpus."""
    c = readers.CORPORA[name]
    raw = R.recode("rating", WRITTEN[name])
    given = {c["text"]: F.col("text"), **({c["label"]: raw} if c["label"] else {}), **{k: F.expr(v) for k, v in BESIDE.get(name, ({}, ""))[0].items()}}
    columns = [x.split()[0] for x in c["columns"].split(", ")] if c["columns"] else sorted(given)
    laid = rows.select(*[given.get(k, F.lit("-")).cast("string").alias(k) for k in columns])
    laid.write.option("header", c["header"]).option("sep", c["sep"]).option("encoding", c["encoding"]).option("escape", '"').csv(path)


def _label(name: str) -> str:
    c = readers.CORPORA[name]
    if c["label"] is None:
        return "1"
    mapped = {k: int(v) if c["binary"] is None else R.BINARY[c["binary"]][v.strip().lower()] for k, v in WRITTEN[name].items()}
    return "CASE rating " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapped.items()) + " END"


def _corpus_sql(name: str) -> str:
    kept = BESIDE.get(name, ({}, "true"))[1]
    cleaned = r"lower(regexp_replace(regexp_replace(text, '[^0-9A-Za-z\s]', '', 'g'), '^\s+|\s+$', '', 'g'))"
    rows = f"SELECT text, {'rating' if name != 'emergent' else _RAW_EMERGENT + ' AS raw, any_value(rating) AS rating'} FROM articles WHERE {kept}{' GROUP BY ALL' if name == 'emergent' else ''}"
    return f"WITH {ARTICLES} SELECT md5({cleaned}) AS text_md5, CAST({_label(name)} AS INTEGER) AS label, count(*) AS n FROM ({rows}) GROUP BY ALL"


_RAW_EMERGENT = "CASE rating WHEN 'ftrue' THEN 'true' WHEN 'mixture' THEN 'unknown' ELSE 'false' END"

for _n, _name in ((3, "imdb"), (4, "liar"), (5, "combined"), (6, "rashkin"), (7, "buzzfeed"), (8, "snopes"), (9, "snopes312"), (10, "buzzfeed_top"), (11, "emergent"), (12, "perez")):

    @query(f"src_{_n:02d}_{_name}_files", _corpus_sql(_name))
    def _files(spark, sf_dir, name=_name):
        """All labelled articles, written in a corpus's layout and loaded by its loader: how often each cleaned text has each label."""
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _laid_out(articles(spark, sf_dir), name, path)
        return readers.corpus(spark, name, path).groupBy(F.md5("text").alias("text_md5"), "label").agg(F.count("*").alias("n"))
