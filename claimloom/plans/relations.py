"""Queries of joins, deduplication, set operations, labels, sampling and crosstabs."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators.numbering import numbered
from claimloom.operators import crosstab as X
from claimloom.operators import relational as R
from claimloom.plans.base import ARTICLES, CLASSED, articles, classed, query, quoted, table

EVENTS = ("click", "purchase", "error", "signup", "view")


def _case(c: str, mapping: dict) -> str:
    return f"CASE {' '.join(f'WHEN {c} = {quoted([k])} THEN {v if isinstance(v, int) else quoted([v])}' for k, v in mapping.items())} END"


@query("jon_01_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def jon_01(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("jon_02_inner_distinct", "SELECT DISTINCT a.source, b.lang FROM documents a JOIN (SELECT DISTINCT source, lang FROM documents) b ON a.source = b.source")
def jon_02(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("source").distinct().join(d.select("source", "lang").distinct(), "source").select("source", "lang").dropDuplicates()


@query("jon_03_row_id", "SELECT a.item_id, b.doc_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS r FROM benchmark) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM labels) b ON a.r = b.r")
def jon_03(spark, sf_dir):
    return R_zip(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("item_id", "doc_id")


def R_zip(a, a_key, b, b_key):
    return numbered(a, a_key).join(numbered(b, b_key), "row_id")


@query("jon_04_right", "SELECT d.doc_id, l.quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
def jon_04(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "right").select("doc_id", "quality")


@query("jon_05_by_id", "SELECT d.doc_id, d.n_chars, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def jon_05(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", "toxic")


@query("jon_06_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def jon_06(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("jon_07_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon_07(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("ded_01_rows", "SELECT DISTINCT text, lang FROM documents")
def ded_01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text", "lang").dropDuplicates()


@query("ded_02_keep_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, text")
def ded_02(spark, sf_dir):
    return R.keep_first(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["lang", "text"], "doc_id").select("doc_id")


@query("ded_03_keep_last_but", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text, lang, n_chars ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def ded_03(spark, sf_dir):
    return R.keep_first_but(table(spark, sf_dir, "documents"), ["doc_id", "source"], "doc_id", last=True).select("doc_id")


@query("ded_04_checked_wins", "SELECT doc_id, checked FROM (SELECT d.doc_id, l.doc_id IS NOT NULL AS checked, row_number() OVER (PARTITION BY text ORDER BY l.doc_id IS NOT NULL DESC, d.doc_id DESC) AS r FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE r = 1")
def ded_04(spark, sf_dir):
    seen = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("checked"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(seen, "doc_id", "left").withColumn("checked", F.coalesce("checked", F.lit(False)))
    return R.keep_first(d, ["text"], "checked", "doc_id", last=True).select("doc_id", "checked")


_CLAIM = r"lower(regexp_replace(regexp_replace({}, '[^0-9A-Za-z\s]', '', 'g'), '^\s+|\s+$', '', 'g'))"


@query("ded_05_overlap", f"SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND {_CLAIM.format('text')} NOT IN (SELECT {_CLAIM.format('text')} FROM documents WHERE doc_id % 5 <> 0)")
def ded_05(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return R.without_overlap(d.filter("doc_id % 5 = 0"), d.filter("doc_id % 5 <> 0"), T.clean_str("text")).select("doc_id")


@query("set_01_union", "SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def set_01(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), allowMissingColumns=True)


@query("set_02_difference", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def set_02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@query("set_03_complement", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'gold' ELSE 'rest' END AS part FROM labels")
def set_03(spark, sf_dir):
    l, gold = table(spark, sf_dir, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0)
    return l.filter(gold).withColumn("part", F.lit("gold")).unionByName(l.filter(~gold).withColumn("part", F.lit("rest"))).select("doc_id", "part")


@query("set_04_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_04(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("set_04_columns", "SELECT column_name AS name FROM (DESCRIBE documents) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE labels))")
def set_04_columns(spark, sf_dir):
    names = R.other_columns(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return spark.createDataFrame([(c,) for c in names], "name string")


for _name, _maps in (("binary", R.BINARY), ("fine", R.FINE)):
    for _set in ("snopes", "combined"):

        @query(f"lbl_01_{_name}_{_set}", f"WITH {ARTICLES} SELECT doc_id, {_case('rating', _maps[_set])} AS label FROM articles")
        def _lbl(spark, sf_dir, m=_maps[_set]):
            return articles(spark, sf_dir).select("doc_id", R.recode("rating", m).alias("label"))


for _key, _set, _sql in (
    ("src_04_liar", "liar", "CASE rating WHEN 'ftrue' THEN 'true' WHEN 'mixture' THEN 'half-true' WHEN 'mfalse' THEN 'barely-true' ELSE 'pants-fire' END"),
    ("src_06_rashkin", "rashkin", "CASE rating WHEN 'ftrue' THEN '4' WHEN 'mixture' THEN '3' WHEN 'mfalse' THEN '2' ELSE '1' END"),
    ("src_07_buzzfeed", "buzzfeed", "CASE rating WHEN 'ftrue' THEN 'mostly true' WHEN 'mixture' THEN 'mixture of true and false' WHEN 'mfalse' THEN 'mostly false' ELSE 'no factual content' END"),
    ("src_09_snopes312", "snopes312", "CASE rating WHEN 'ftrue' THEN 'true' WHEN 'mixture' THEN 'mixture' WHEN 'mfalse' THEN 'mostly false' ELSE 'false' END"),
    ("src_11_emergent", "emergent", "CASE rating WHEN 'ftrue' THEN 'true' WHEN 'mixture' THEN 'unknown' ELSE 'false' END"),
    ("src_12_perez", "perez", "CASE WHEN rating IN ('ftrue', 'mixture') THEN 'legit' ELSE 'fake' END"),
):

    @query(_key, f"WITH {ARTICLES}, x AS (SELECT doc_id, {_CLAIM.format('text')} AS text, {_sql} AS raw FROM articles) SELECT doc_id, text, {_case('raw', R.BINARY[_set])} AS label FROM x")
    def _src(spark, sf_dir, sql=_sql, name=_set):
        raw = articles(spark, sf_dir).withColumn("raw", F.expr(sql))
        return raw.select("doc_id", T.clean_str("text").alias("text"), R.recode("raw", R.BINARY[name]).alias("label"))


@query("lbl_02_codes", f"WITH {ARTICLES} SELECT doc_id, CAST(dense_rank() OVER (ORDER BY rating) - 1 AS INTEGER) AS code FROM articles")
def lbl_02(spark, sf_dir):
    return R.codes(articles(spark, sf_dir), "rating").select("doc_id", "code")


@query("lbl_03_scale", "SELECT doc_id, toxic * 4 + 1 AS scaled FROM labels")
def lbl_03(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") * (5 - 1) + 1).alias("scaled"))


_SOFT = "[greatest(0.0, 1 - abs(1 + value % 4 - k)) for k in [1, 2, 3, 4, 5]]"


@query("lbl_04_soft", f"SELECT event_id, list_transform({_SOFT}, lambda x: round(x, 6)) AS p FROM (SELECT event_id, value FROM events)")
def lbl_04(spark, sf_dir):
    p = R.soft(1 + F.col("value") % 4, 5)
    return table(spark, sf_dir, "events").select("event_id", F.transform(p, lambda x: F.round(x, 6)).alias("p"))


@query("lbl_05_decode", f"WITH s AS (SELECT event_id, {_SOFT} AS p FROM events) SELECT event_id, list_position(p, list_max(p)) AS class, round(p[1] + 2 * p[2] + 3 * p[3] + 4 * p[4] + 5 * p[5], 6) AS mean FROM s")
def lbl_05(spark, sf_dir):
    p = R.soft(1 + F.col("value") % 4, 5)
    return table(spark, sf_dir, "events").select("event_id", R.argmax(p).cast("int").alias("class"), F.round(R.expectation(p), 6).alias("mean"))


@query("lbl_06_one_hot", "SELECT doc_id, [CAST(quality = k AS INTEGER)::DOUBLE for k in [0, 1]] AS hot FROM labels")
def lbl_06(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", R.one_hot(F.col("quality"), 2).alias("hot"))


_NUMBERED = CLASSED + ", n AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat(doc_id, '-', {seed})), doc_id) AS r, count(*) OVER (PARTITION BY label) AS f FROM classed)"


@query("smp_01_balance", f"WITH {_NUMBERED.format(seed=1)} SELECT doc_id, label, CAST(c AS INTEGER) AS copy FROM (SELECT *, unnest(range(0, CASE WHEN f >= 100 THEN CASE WHEN r <= 100 THEN 1 ELSE 0 END ELSE (100 - r) // f + 1 END)) AS c FROM n WHERE r <= 100)")
def smp_01(spark, sf_dir):
    return R.balance(classed(spark, sf_dir).select("doc_id", "label"), "label", "doc_id", 100, seed=1)[0].select("doc_id", "label", "copy")


@query("smp_01_remaining", f"WITH {_NUMBERED.format(seed=1)} SELECT doc_id, label FROM n WHERE r > 100")
def smp_01_remaining(spark, sf_dir):
    return R.balance(classed(spark, sf_dir).select("doc_id", "label"), "label", "doc_id", 100, seed=1)[1].select("doc_id", "label")


@query("smp_02_chained", f"WITH {_NUMBERED.format(seed=2)} SELECT doc_id, label, CASE WHEN r <= 10 THEN 'test' WHEN r <= 20 THEN 'valid' ELSE 'train' END AS part FROM n WHERE r <= 50")
def smp_02(spark, sf_dir):
    return R.split_ranges(classed(spark, sf_dir).select("doc_id", "label"), "label", "doc_id", {"test": 10, "valid": 10, "train": 30}, 2).select("doc_id", "label", "part")


@query("smp_03_upsample", f"WITH {_NUMBERED.format(seed=3)}, m AS (SELECT max(f) AS m FROM n) SELECT label, count(*) AS n FROM (SELECT label, unnest(range(0, (m.m - r) // f + 1)) FROM n, m) GROUP BY label")
def smp_03(spark, sf_dir):
    rows = classed(spark, sf_dir).select("doc_id", "label")
    most = rows.groupBy("label").count().agg(F.max("count")).first()[0]  # one number
    return R.balance(rows, "label", "doc_id", most, seed=3)[0].groupBy("label").agg(F.count("*").alias("n"))


_U = "CAST('0x' || substring(md5(concat(doc_id, '-', {seed})), 1, 8) AS BIGINT) / 4294967296.0"


@query("smp_04_fractions", f"SELECT doc_id, CASE WHEN {_U.format(seed=4)} < 0.65 THEN 'train' WHEN {_U.format(seed=4)} < 0.75 THEN 'dev' ELSE 'test' END AS part FROM labels")
def smp_04(spark, sf_dir):
    return R.split_fractions(table(spark, sf_dir, "labels"), "doc_id", {"train": 0.65, "dev": 0.10, "test": 0.25}, 4).select("doc_id", "part")


@query("smp_05_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, '-', 5)), doc_id) AS place FROM labels")
def smp_05(spark, sf_dir):
    return numbered(table(spark, sf_dir, "labels").select("doc_id"), R.ticket("doc_id", 5), "place").select("doc_id", F.col("place").cast("long").alias("place"))


@query("smp_06_split", f"SELECT doc_id, CASE WHEN {_U.format(seed=6)} < 0.8 THEN 'train' ELSE 'test' END AS part FROM labels")
def smp_06(spark, sf_dir):
    return R.split_fractions(table(spark, sf_dir, "labels"), "doc_id", {"train": 0.8, "test": 0.2}, 6).select("doc_id", "part")


@query("smp_07_kfold", f"WITH {CLASSED} SELECT doc_id, CAST(ntile(3) OVER (PARTITION BY label ORDER BY doc_id) AS INTEGER) AS fold FROM classed")
def smp_07(spark, sf_dir):
    return R.folds(classed(spark, sf_dir).select("doc_id", "label"), "label", "doc_id", 3).select("doc_id", "fold")


@query("smp_08_per_source", f"WITH {CLASSED}, n AS (SELECT doc_id, source, label, row_number() OVER (PARTITION BY source, label ORDER BY md5(concat(doc_id, '-', 8)), doc_id) AS r FROM classed) SELECT doc_id, source, label FROM n WHERE r <= CASE source WHEN 'src0' THEN 4 WHEN 'src1' THEN 2 ELSE 0 END")
def smp_08(spark, sf_dir):
    sizes = spark.createDataFrame([("src0", 4), ("src1", 2)], "source string, size int")
    from pyspark.sql import Window

    rows = classed(spark, sf_dir).join(F.broadcast(sizes), "source")  # a row a source that is asked for
    r = F.row_number().over(Window.partitionBy("source", "label").orderBy(*R.ticket("doc_id", 8)))
    top = rows.withColumn("_r", r).filter("_r <= 4")  # the largest size, told: each task keeps so many before the shuffle
    return top.filter("_r <= size").select("doc_id", "source", "label")


@query("smp_09_discard", "SELECT doc_id, label, CASE WHEN r <= 10 THEN 'test' WHEN r <= 20 THEN 'dev' ELSE 'train' END AS part FROM (SELECT doc_id, doc_id % 8 AS label, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY md5(concat(doc_id, '-', 9)), doc_id) AS r FROM labels WHERE doc_id % 8 NOT IN (6, 7)) WHERE r <= 50")
def smp_09(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 8).alias("label"))
    return R.split_ranges(rows, "label", "doc_id", {"test": 10, "dev": 10, "train": 30}, 9, (6, 7)).select("doc_id", "label", "part")


@query("agg_01_value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def agg_01(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("agg_03_describe", "WITH c AS (SELECT text AS v, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS top, max(n) AS freq FROM c")
def agg_03(spark, sf_dir):
    return X.describe(table(spark, sf_dir, "documents"), "text")


@query("agg_04_crosstab", f"WITH {ARTICLES} SELECT source, count(*) FILTER (rating = 'ftrue') AS ftrue, count(*) FILTER (rating = 'mixture') AS mixture, count(*) FILTER (rating = 'mfalse') AS mfalse, count(*) FILTER (rating = 'ffalse') AS ffalse FROM articles GROUP BY source")
def agg_04(spark, sf_dir):
    return X.crosstab(articles(spark, sf_dir), "source", "rating", ["ftrue", "mixture", "mfalse", "ffalse"])


@query("agg_05_crosstab_margins", f"WITH {ARTICLES} SELECT lang, rating, count(*) AS n FROM articles GROUP BY CUBE (lang, rating)")
def agg_05(spark, sf_dir):
    return X.crosstab_margins(articles(spark, sf_dir), "lang", "rating")


@query("agg_06_group_means", f"WITH {CLASSED} SELECT label, round(avg(length(text)), 6) AS mean_length, round(avg(quality), 6) AS mean_quality FROM classed GROUP BY label")
def agg_06(spark, sf_dir):
    return classed(spark, sf_dir).groupBy("label").agg(F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.round(F.avg("quality"), 6).alias("mean_quality"))


@query("agg_07_class_ratio", f"WITH {CLASSED} SELECT round(avg(length(text)) FILTER (label = 1) / avg(length(text)) FILTER (label = 0), 6) AS ratio FROM classed")
def agg_07(spark, sf_dir):
    n = lambda k: F.avg(F.when(F.col("label") == k, F.length("text")))
    return classed(spark, sf_dir).agg(F.round(F.try_divide(n(1), n(0)), 6).alias("ratio"))


_VOTES = "WITH v AS (SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{o}') AS n{k}" for k, o in enumerate(EVENTS)) + " FROM events GROUP BY user_id), w AS (SELECT user_id, greatest(n0, n1, n2, n3, n4) AS votes, n0 + n1 + n2 + n3 + n4 AS all_votes, n0, n1, n2, n3, n4 FROM v), m AS (SELECT user_id, CASE " + " ".join(f"WHEN n{k} = votes THEN '{o}'" for k, o in enumerate(EVENTS)) + " END AS winner, votes, all_votes FROM w)"


def _majority(spark, sf_dir):
    return X.majority(table(spark, sf_dir, "events"), "user_id", "event_type", EVENTS)


@query("agg_08_majority", _VOTES + " SELECT user_id, winner, votes FROM m")
def agg_08(spark, sf_dir):
    return _majority(spark, sf_dir).select("user_id", "winner", "votes")


@query("agg_09_agreement", _VOTES + " SELECT user_id, round(votes / all_votes, 6) AS agreement, votes = all_votes AS unanimous FROM m")
def agg_09(spark, sf_dir):
    return _majority(spark, sf_dir).select("user_id", F.round("agreement", 6).alias("agreement"), (F.col("votes") == F.col("all_votes")).alias("unanimous"))


@query("agg_10_vote_histogram", _VOTES + " SELECT winner, votes, count(*) AS n FROM m GROUP BY CUBE (winner, votes)")
def agg_10(spark, sf_dir):
    return X.crosstab_margins(_majority(spark, sf_dir), "winner", "votes")


@query("flt_09_full_agreement", _VOTES + " SELECT user_id FROM m WHERE winner = 'click' AND votes = all_votes")
def flt_09(spark, sf_dir):
    return _majority(spark, sf_dir).filter((F.col("winner") == "click") & (F.col("agreement") == 1)).select("user_id")


@query("flt_10_gold", "SELECT event_id FROM events WHERE event_type = 'click' AND value <= 20 AND NOT (user_id IS NOT DISTINCT FROM 8)")
def flt_10(spark, sf_dir):
    return table(spark, sf_dir, "events").filter((F.col("event_type") == "click") & (F.col("value") <= 20) & ~F.col("user_id").eqNullSafe(8)).select("event_id")


@query("flt_12_first_citation", "WITH a AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)[1] AS href FROM pages) SELECT page_id, href FROM a WHERE href IS NOT NULL AND NOT regexp_matches(lower(href), '\\.pdf|\\.jpg|\\.jpeg|\\.png|\\.gif|jfif|\\.mp3|\\.mp4')")
def flt_12(spark, sf_dir):
    from claimloom.functions import web as W
    from claimloom.operators import filters

    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(W.anchors("html")).alias("p", "href")).withColumn("first", F.col("p") == 0)
    return filters.first_citations(rows, "href", "first").select("page_id", "href")


@query("agg_13_longest", "SELECT lang, max(length(text)) AS longest FROM documents GROUP BY lang")
def agg_13(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.max(F.length("text")).cast("long").alias("longest"))


@query("agg_14_consensus", "SELECT doc_id, CASE WHEN quality = toxic THEN quality ELSE doc_id % 2 END AS agreed FROM labels")
def agg_14(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("third", F.col("doc_id") % 2)
    return rows.select("doc_id", X.consensus("quality", "toxic", "third").cast("long").alias("agreed"))


@query("agg_15_gold_marks", "SELECT doc_id, (doc_id % 2 = quality OR doc_id % 2 = toxic) AS gold FROM labels")
def agg_15(spark, sf_dir):
    third = F.col("doc_id") % 2
    return table(spark, sf_dir, "labels").select("doc_id", ((third == F.col("quality")) | (third == F.col("toxic"))).alias("gold"))


@query("agg_16_disagreement", "SELECT quality, toxic, count(*) AS n FROM labels WHERE quality <> toxic GROUP BY ALL")
def agg_16(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter("quality <> toxic").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("agg_17_lines", "SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n FROM documents")
def agg_17(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.sum(F.size(F.split("text", "\n"))).alias("n"))


@query("agg_18_overview", f"WITH {ARTICLES} SELECT source, rating, lang, count(*) AS n FROM articles GROUP BY GROUPING SETS ((source, rating), (lang, rating))")
def agg_18(spark, sf_dir):
    a = articles(spark, sf_dir)
    one = a.groupBy("source", "rating").agg(F.count("*").alias("n"))
    two = a.groupBy("lang", "rating").agg(F.count("*").alias("n"))
    return one.unionByName(two, allowMissingColumns=True).select("source", "rating", "lang", "n")


@query("srt_01_sorted", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def srt_01(spark, sf_dir):
    return numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("srt_02_top_n", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def srt_02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
