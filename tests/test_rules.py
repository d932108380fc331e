"""Small cases of single operators, invariants, files and streams."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import web as W
from claimloom.operators import crosstab, enrich, evaluate, features, filters, relational
from claimloom.operators.numbering import numbered, numbered_within
from claimloom.sources import readers
from claimloom.streaming import incremental


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f("x")).first()[0]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (T.ascii_only, "a’bñ “q”", "ab q"),
        (T.plain_quotes, "‘x’ “y”，", "'x' \"y\","),
        (T.mask_emails, "mail <robetded@ix.netcom.com> now", "mail <_EMAIL_> now"),
        (T.mask_links, "see http://a.b, and http://c.d. x http://e", "see _LINKS_, and _LINKS_. x _LINKS_"),
        (T.question_marks, "don?t ?abc? x", "don?t abcx"),
        (T.drop_bracketed, "WASHINGTON (CNN) [Update] text", "WASHINGTON   text"),
        (T.clean_str, "He said: \"It's 5_000!\" ", "he said its 5000"),
        (T.from_paragraphs, "<p>a</p><p>b</p>", " a  b "),
        (T.fix_mojibake, "a\xe2\x80\x99b\xe2\x80\xa6", "a'b..."),
        (T.clean_claim_example, " x SeeExample( s ) ", "x"),
        (T.shorten, "x" * 81, "x" * 77 + "..."),
        (T.for_transformer, "I can't see you &amp; me @bob , ok?", "I can not see ok ?"),
        (T.count_words, "a 1 b2 -", 2),
        (W.netloc, "http://u@www.x.org:80/a?b=1", "u@www.x.org:80"),
        (W.registered_domain, "http://u@www.x.org:80/a?b=1", "x.org"),
        (W.is_media, "http://x/a.PDF?v=1", True),
        (W.parse_timestamp, "Monday, July 2nd, 2018 at 4:18 p.m.", datetime.date(2018, 7, 2)),
        (W.get_text, "<p>a<br>b &amp;lt; <script>x</script><!-- y --></p>", "a b &lt;"),
        (T.clean_str, None, None),
        (T.clean_text, "", ""),
    ],
)
def test_scalars(spark, f, given, expected):
    assert one(spark, f, given) == expected


def test_status_order(spark):
    rows = [("", "u"), ("w " * 20000, "u"), ("few words", "u"), ("w " * 60, "http://youtu.be/x"), ("w " * 60, "u")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, u string").select(W.article_status("t", "u")).collect()]
    assert got == ["Resource moved", "Article too long", "Article too short", "Not a news article", "No Error"]


def test_labels(spark):
    rows = spark.createDataFrame([("ftrue",), ("mtrue",), ("mfalse",), ("ffalse",), ("mixture",), ("?",)], "r string")
    assert [r[0] for r in rows.select(relational.recode("r", relational.BINARY["snopes"])).collect()] == [0, 0, 1, 1, 5, None]
    with pytest.raises(Exception, match="unknown label"):
        rows.select(relational.recode("r", relational.BINARY["snopes"], strict=True)).collect()


def test_balance_counts(spark):
    sizes = {0: 1496, 1: 1662, 5: 483}
    rows = spark.createDataFrame([(k * 10000 + i, k) for k, n in sizes.items() for i in range(n)], "id long, label int")
    balanced, rest = relational.balance(rows, "label", "id", 1400, (5,))
    assert {r.label: r["count"] for r in balanced.groupBy("label").count().collect()} == {0: 1400, 1: 1400}
    assert {r.label: r["count"] for r in rest.groupBy("label").count().collect()} == {0: 96, 1: 262, 5: 483}
    more, rest = relational.balance(rows, "label", "id", 2000, (5,))
    assert {r.label: r["count"] for r in more.groupBy("label").count().collect()} == {0: 2000, 1: 2000}
    assert rest.count() == 483


def test_folds(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(3200)], "id long, label int")
    got = {r.fold: r["count"] for r in relational.folds(rows, "label", "id").groupBy("fold").count().collect()}
    assert sorted(got.values(), reverse=True) == [1068, 1066, 1066]


def test_votes_and_consensus(spark):
    votes = spark.createDataFrame([(1, "right")] * 2 + [(1, "context")] * 2 + [(2, "right")], "item int, answer string")
    got = {r.item: (r.winner, r.votes, r.agreement) for r in crosstab.majority(votes, "item", "answer").collect()}
    assert got == {1: ("context", 2, 0.5), 2: ("right", 1, 1.0)}
    rows = spark.createDataFrame([("a", "a", "c"), ("a", "b", "c")], "x string, y string, z string")
    assert [r[0] for r in rows.select(crosstab.consensus("x", "y", "z")).collect()] == ["a", "c"]


def test_crosstab_margins_add_up(spark):
    rows = spark.createDataFrame([("for", "true"), ("for", "false"), ("against", "true")], "s string, t string")
    got = {(r.s, r.t): r.n for r in crosstab.crosstab_margins(rows, "s", "t").collect()}
    assert got[(None, None)] == 3 and got[("for", None)] == 2 and got[(None, "true")] == 2


def test_tfidf_norm(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = features.term_counts(rows)
    weights = features.tfidf(counts, features.fit_idf(counts, rows.count()))
    norms = weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s"))
    assert norms.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_report_micro_is_accuracy_and_roc_rises(spark):
    rows = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.7), (1, 1, 0.9), (1, 0, 0.4), (1, 1, 0.8)], "label int, predicted int, score double")
    report = {r.name: r for r in evaluate.report(rows).collect()}
    assert report["micro avg"].f1 == evaluate.summary(rows).first().accuracy == 0.6
    points = sorted(((r.fpr, r.tpr) for r in evaluate.roc(rows).collect()))
    assert points == sorted(points, key=lambda p: p[1]) and points[-1] == (1.0, 1.0)
    assert abs(evaluate.auc(rows).first().auc - 5 / 6) < 1e-12


def test_numbering(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = numbered(rows, "k").collect()
    assert sorted((r.row_id, r.k) for r in got) == [(i + 1, i) for i in range(1000)]


def test_weight_zero_blocks_are_not_read(spark):
    bad = spark.range(1).select(F.raise_error(F.lit("computed")).alias("value"), F.lit(1).alias("doc_id"), F.lit("x").alias("feature"))
    good = spark.createDataFrame([(1, "a", 2.0)], "doc_id int, feature string, value double")
    assert features.union_weighted({"bad": (bad, 0.0), "good": (good, 0.5)}).collect() == [(1, "good:a", 1.0)]


def test_site_cleaner_modes(spark):
    rows = spark.createDataFrame([(1, "word " * 120 + "(AP)"), (2, "short")], "id int, text string")
    assert [r.id for r in filters.clean_site(rows, "text").collect()] == [1]
    assert sorted(r.id for r in filters.clean_site(rows, "text", mode="web").collect()) == [1, 2]


def test_splice_and_productions(spark):
    rows = spark.createDataFrame([("Ann met Bob.", [(0, 3, "[P]"), (8, 11, "[P]")])], "t string, s array<struct<start:int,end:int,label:string>>")
    assert rows.select(enrich.splice("t", "s")).first()[0] == "[P] met [P]."
    rules = spark.createDataFrame([(["NP -> DT NN", " DT -> 'the'"],)], "r array<string>")
    assert rules.select(enrich.productions("r", False), enrich.productions("r", True)).first() == (["NP -> DT NN"], [" DT -> 'the'"])


def test_files(spark, tmp_path):
    (tmp_path / "liar.tsv").write_text("1\thalf-true\tA b!\tx\n2\tfalse\tC\ty\n")
    assert [(r.text, r.label) for r in readers.corpus(spark, "liar", str(tmp_path / "liar.tsv")).collect()] == [("a b", 0), ("c", 1)]
    (tmp_path / "perez.csv").write_text(',text,label\n0,"One, ""two""",legit\n1,Café,fake\n', encoding="ISO-8859-1")
    assert [(r.text, r.label) for r in readers.corpus(spark, "perez", str(tmp_path / "perez.csv")).collect()] == [("one two", 0), ("caf", 1)]
    (tmp_path / "e.csv").write_text("claimId,claimTruthiness,articleId,articleStance,articleBody\n1,true,a,for,Body\n1,true,b,for,Body\n2,false,c,against,B\n3,unknown,d,for,C\n")
    assert sorted((r.text, r.label) for r in readers.corpus(spark, "emergent", str(tmp_path / "e.csv")).collect()) == [("body", 0), ("c", 5)]
    lex = tmp_path / "lex"
    lex.mkdir()
    (lex / "hedges.txt").write_text("# list\nmay might\nmay\n")
    assert sorted(tuple(r) for r in readers.lexicons(spark, str(lex)).collect()) == [("hedges", "may"), ("hedges", "might")]
    (tmp_path / "v.txt").write_text("a 1 2\nb 3 4\nbad 1\n")
    assert [(r.term, r.vector) for r in readers.vectors(spark, str(tmp_path / "v.txt"), 2).collect()] == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    matrix = spark.createDataFrame([("good", 1.0, 0.0, 5.0), ("bad", 0.0, 2.0, 5.0)], "`Source (A)` string, posemo double, negemo double, WC double")
    assert sorted(tuple(r) for r in readers.category_matrix(matrix).collect()) == [("negemo", "bad"), ("posemo", "good")]
    stories = tmp_path / "stories"
    stories.mkdir()
    (stories / "s.story").write_text("One\n@highlight\nTwo")
    assert readers.stories(spark, str(stories)).first().text == "One  Two"
    (tmp_path / "fixed.txt").write_text('3"Hoax text"\n')
    assert tuple(readers.fixed_width(spark, str(tmp_path / "fixed.txt")).first()) == ("3", "Hoax text")
    rows = spark.createDataFrame([(1, 'a "q", b')], "id int, text string")
    readers.write_csv(rows, str(tmp_path / "out"), compression="gzip")
    assert readers.csv(spark, str(tmp_path / "out")).first().text == 'a "q", b'
    assert readers.snapshot(rows, str(tmp_path / "snap")).count() == 1


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "events")
    events.repartition(3).write.parquet(folder)
    query = incremental.append_log(incremental.stream_parquet(spark, folder), str(tmp_path / "log"), str(tmp_path / "c1"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()
    counts = incremental.daily_counts(incremental.stream_parquet(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")))
    query = counts.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = incremental.daily_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: sorted((str(r.day), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("daily")) == key(batch)
    query = incremental.upsert(incremental.stream_parquet(spark, folder).select("user_id", "event_id"), str(tmp_path / "snap"), str(tmp_path / "c2"), "user_id", "event_id")
    query.awaitTermination(60)
    last = spark.read.parquet(str(tmp_path / "snap" / "v0"))
    assert last.count() == events.select("user_id").distinct().count()


def test_refresh(spark):
    old = spark.createDataFrame([(1, 1), (2, 1)], "k int, o int")
    new = spark.createDataFrame([(2, 2)], "k int, o int")
    assert sorted(map(tuple, incremental.refresh(old, new, "k", "o").collect())) == [(1, 1), (2, 2)]
    assert incremental.refresh(old, new, "k", "o", full=True) is old
    assert incremental.newer(new, old, "o").count() == 1


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_models_reload_and_weigh_terms(spark, tmp_path):
    from claimloom.operators import models as M

    rows = spark.createDataFrame([(i, ("good fine " if i % 2 else "bad poor ") * 3 + f"word{i % 3} both", i % 2) for i in range(60)], "doc_id long, text string, label int")
    model = M.fit_pipeline(rows, "svc", features=256)
    M.save(model, str(tmp_path / "m"))
    before, after = ({r.doc_id: (r.predicted, round(r.decision, 9)) for r in M.decisions(m, rows).collect()} for m in (model, M.load(str(tmp_path / "m"))))
    assert before == after and all(p == k % 2 and (d > 0) == bool(k % 2) for k, (p, d) in before.items())
    weights = M.term_weights(rows, "svc")
    best = {(r.label, r.term) for r in M.top_terms(weights, 2).collect()}
    assert best == {(1, "good"), (1, "fine"), (0, "bad"), (0, "poor")}
    score = {r.term: r.score for r in M.squared(weights).collect()}
    assert max(score.values()) == 1.0 and score["both"] < 0.01
    assert {r.term for r in M.term_weights(rows, "l1").filter("abs(weight) >= 1e-5").collect()} <= {"good", "fine", "bad", "poor"}


def test_numbers_stay_whole_where_rows_are_wide(spark, tmp_path):
    """The ranges' bounds come from a sample: counting and numbering must see the same ones."""
    path = str(tmp_path / "wide")
    spark.range(0, 300_000, 1, 3).selectExpr("id", "xxhash64(id) AS h", "cast(id AS string) AS a", "id * 3 AS b").write.parquet(path)
    numbered(spark.read.parquet(path), ["h", "id"]).select("a", "b", "h", "row_id").write.parquet(path + "-numbered")  # all columns are read
    got = spark.read.parquet(path + "-numbered")
    n, distinct, least, most = got.selectExpr("count(*)", "count(distinct row_id)", "min(row_id)", "max(row_id)").first()
    assert (n, distinct, least, most) == (300_000, 300_000, 1, 300_000) and got.selectExpr("sum(b)").first()[0] == 3 * sum(range(300_000))


def test_numbers_within_groups(spark):
    rows = [(None if k % 7 == 0 else "hot" if k % 3 else f"g{k % 5}", k) for k in range(500)]
    got = numbered_within(spark.createDataFrame(rows, "g string, k long"), ["g"], [F.desc("k")]).collect()
    for g in {g for g, _ in rows}:
        mine = sorted((k for x, k in rows if x == g), reverse=True)
        assert sorted((r._r, r.k, r._f) for r in got if r.g == g) == [(i + 1, k, len(mine)) for i, k in enumerate(mine)]
    empty = numbered_within(spark.createDataFrame([], "g string, k long"), ["g"], ["k"])
    assert empty.columns == ["g", "k", "_r", "_f"] and empty.count() == 0


def test_folds_are_contiguous_blocks(spark):
    for n, sizes in ((10, [4, 3, 3]), (2, [1, 1]), (9, [3, 3, 3])):
        got = relational.folds(spark.createDataFrame([("x", k) for k in range(n)], "label string, k long"), "label", "k", 3).orderBy("k").collect()
        assert [r.fold for r in got] == [f + 1 for f, m in enumerate(sizes) for _ in range(m)]


def test_keep_first_of_nulls_and_ties(spark):
    rows = [("a", None, 1, 5), ("a", 3, 2, 6), (None, 2, 3, 7), (None, 2, 4, 8)]
    d = spark.createDataFrame(rows, "key string, o long, id long, `a.b` long")
    pick = lambda **how: sorted(r.id for r in relational.keep_first(d, ["key"], "o", "id", **how).collect())
    assert pick() == [1, 3] and pick(last=True) == [2, 4]
    assert relational.keep_first(d, ["key"], "o", "id").columns == d.columns


def test_ensemble_drops_documents_on_which_a_block_fails(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, feature string, value double")
    a, b = frame([(1, "x", 1.0), (2, "x", None), (3, "x", 3.0)]), frame([(1, "x", 4.0), (2, "x", 5.0)])
    assert sorted(tuple(r) for r in features.ensemble({"a": a, "b": b}).collect()) == [(1, "a:x", 1.0), (1, "b:x", 4.0)]


def test_unknown_terms_get_numbers_that_stay(spark):
    terms, vectors = spark.createDataFrame([("a",), ("b",), ("c",)], "term string"), spark.createDataFrame([("a", [1.0, 2.0])], "term string, vector array<float>")
    got = {r.term: (r.known, r.vector) for r in features.with_unknown(terms, vectors, 2).collect()}
    assert got["a"] == (True, [1.0, 2.0]) and not got["b"][0] and got["b"][1] != got["c"][1]
    assert all(-1 <= x < 1 for t in "bc" for x in got[t][1])
    assert got == {r.term: (r.known, r.vector) for r in features.with_unknown(terms.repartition(3), vectors, 2).collect()}


def test_four_way_answers(spark, sf_dir):
    from claimloom.plans import catalog

    rows = catalog.QUERIES["api_01_genera"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert [c.axis for c in r.confidence] == ["Trusted", "Propaganda", "Satire", "Hoax"]
        values = [c.value for c in r.confidence]
        assert abs(sum(values) - 1) < 1e-6 and values[r.label] == max(values) and r.confidence[r.label].axis == r.name


def test_pooled_topics_are_shares(spark, sf_dir):
    from claimloom.plans import catalog

    rows = catalog.QUERIES["mdl_12_pooled_topics"](spark, sf_dir).collect()
    assert sorted(r.label for r in rows) == [0, 1] and all(abs(sum(r.topics) - 1) < 1e-6 for r in rows)
