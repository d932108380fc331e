"""Queries of sources, sinks, incremental processing, enrichment and the serving endpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import web as W
from claimloom.operators import enrich
from claimloom.operators.storage import shared_folder
from claimloom.plans.base import articles, classed, query, table
from claimloom.plans.cleaning import _COLLAPSE, _ENTITIES, _HOST, _STRIPPED
from claimloom.sources import readers
from claimloom.streaming import incremental, keyed

_BODY = r"CASE WHEN regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) <> '' THEN regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) ELSE html END"


@query("src_23_article", f"WITH b AS (SELECT page_id, {_BODY} AS html FROM pages) SELECT page_id, {_COLLAPSE.format(_ENTITIES.format(_STRIPPED))} AS text FROM b")
def src_23(spark, sf_dir):
    return readers.article(table(spark, sf_dir, "pages")).select("page_id", "text")


@query("src_24_site_links", f"WITH p AS (SELECT page_id, {_HOST} AS host, html FROM pages), h AS (SELECT page_id, host, unnest(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)) AS href FROM p WHERE contains(host, 'example')) SELECT page_id, href FROM h WHERE starts_with(href, '/') OR contains(href, host)")
def src_24(spark, sf_dir):
    return readers.landed(table(spark, sf_dir, "pages"), "example")


@query("snk_07_merge", "SELECT user_id, arg_max(event_id, (part, event_id)) AS event_id FROM (SELECT *, CASE WHEN event_id < 500 THEN 0 ELSE 1 END AS part FROM events) GROUP BY user_id")
def snk_07(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return readers.merged(e.filter("event_id < 500"), e.filter("event_id >= 500"), "user_id", "event_id").select("user_id", "event_id")


@query("snk_10_json", "SELECT doc_id, to_json(struct_pack(doc_id := doc_id, quality := quality, toxic := toxic)) AS json FROM labels")
def snk_10(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.to_json(F.struct("doc_id", "quality", "toxic")).alias("json"))


@query("inc_01_newer", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id < 500)")
def inc_01(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return incremental.newer(e, e.filter("event_id < 500"), "ts").select("event_id")


@query("inc_02_refresh", "SELECT user_id, arg_max(event_type, (CASE WHEN event_id < 500 THEN 0 ELSE 1 END, event_id)) AS event_type FROM events GROUP BY user_id")
def inc_02(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return incremental.refresh(e.filter("event_id < 500"), e.filter("event_id >= 500"), "user_id", "event_id").select("user_id", "event_type")


@query("inc_02_keyed_snapshot", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def inc_02_keyed(spark, sf_dir):
    """Each user's newest event, kept over a stream of all events in batches of any order."""
    place = f"{shared_folder(spark)}/claimloom-streams/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    events.repartition(4, "event_id").write.parquet(f"{place}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    keyed.kept(stream, f"{place}/snapshot", f"{place}/checkpoint", "user_id", "ts", buckets=8).awaitTermination()
    return keyed.snapshot(spark, f"{place}/snapshot", events.schema)


@query("inc_daily_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def inc_daily(spark, sf_dir):
    return incremental.daily_counts(table(spark, sf_dir, "events")).select("day", "event_type", "n", F.round("total", 4).alias("total"))


@query("inc_json_property", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def inc_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("udf_01_anonymise", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\w.-]+@[\w.-]+', '[EMAIL]', 'g'), '[0-9]+', '[NUMBER]', 'g'), '[A-Z][a-z]+ [A-Z][a-z]+', '[NAME]', 'g') AS text FROM documents")
def udf_01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", enrich.anonymise("text").alias("text"))


@query("udf_03_productions", "WITH r AS (SELECT doc_id, ['NP -> DT NN', 'DT -> ''' || lang || '''', 'S -> NP VP'] AS r FROM documents) SELECT doc_id, list_filter(r, lambda x: contains(string_split(x, '-> ')[2], '''')) AS lexical, list_filter(r, lambda x: NOT contains(string_split(x, '-> ')[2], '''')) AS others FROM r")
def udf_03(spark, sf_dir):
    rules = F.array(F.lit("NP -> DT NN"), F.concat(F.lit("DT -> '"), "lang", F.lit("'")), F.lit("S -> NP VP"))
    rows = table(spark, sf_dir, "documents").select("doc_id", rules.alias("r"))
    return rows.select("doc_id", enrich.productions("r", True).alias("lexical"), enrich.productions("r", False).alias("others"))


@query("udf_05_model", r"SELECT doc_id, CAST(length(text) AS BIGINT) AS result FROM documents")
def udf_05(spark, sf_dir):
    return enrich.apply_model(table(spark, sf_dir, "documents"), _lengths, "long")


def _lengths():
    return lambda texts: [len(t) for t in texts]


@query("mdl_16_softmax", "SELECT doc_id, [round(exp(quality) / (exp(quality) + exp(toxic)), 9), round(exp(toxic) / (exp(quality) + exp(toxic)), 9)] AS p FROM labels")
def mdl_16(spark, sf_dir):
    p = enrich.softmax(F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")))
    return table(spark, sf_dir, "labels").select("doc_id", F.transform(p, lambda x: F.round(x, 9)).alias("p"))


@query("api_01_score")
def api_01(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    from claimloom.operators.models import fit_pipeline

    model = fit_pipeline(classed(spark, sf_dir).select("text", "label"), "logistic")
    rows = table(spark, sf_dir, "documents").select("doc_id", T.clean_str(T.ascii_only(W.get_text("text"))).alias("text"))
    return model.transform(rows).select("doc_id", F.col("prediction").cast("int").alias("label"), vector_to_array("probability").alias("confidence"))


#: The axes of the four-way chart by code (fixed values).
GENERA = ("Trusted", "Propaganda", "Satire", "Hoax")


@query("api_01_genera")
def api_01_genera(spark, sf_dir):
    """API-01: the four-way answer to every document: label, its name, the confidence of each axis."""
    from pyspark.ml.functions import vector_to_array

    from claimloom.operators.models import fit_pipeline

    code = F.col("toxic") * 2 + F.when(F.col("quality") == 1, 0).otherwise(1)  # four classes of the tables at hand
    model = fit_pipeline(articles(spark, sf_dir).select("text", code.cast("int").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL"), "logistic")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.clean_str(T.ascii_only(W.get_text("text"))), F.lit("")).alias("text"))
    scored = model.transform(rows).select("doc_id", F.col("prediction").cast("int").alias("label"), vector_to_array("probability").alias("confidence"))
    axes = F.array(*[F.lit(g) for g in GENERA])
    return scored.select("doc_id", "label", F.get(axes, F.col("label")).alias("name"), F.arrays_zip(axes.alias("axis"), F.col("confidence").alias("value")).alias("confidence"))


@query("api_04_extract", f"SELECT page_id, {_HOST} AS site, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def api_04(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.netloc("url").alias("site"), W.inner("html", "title").alias("title"))


@query("flt_05_rating", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def flt_05(spark, sf_dir):
    return articles(spark, sf_dir).filter(F.lower("rating").isin("ftrue", "mtrue")).select("doc_id")


@query("cube_orders", "SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, o_orderpriority)")
def cube_orders(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.cube("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
