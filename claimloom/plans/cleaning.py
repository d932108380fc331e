"""Queries of the text, filter and URL operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import web as W
from claimloom.operators import filters
from claimloom.plans.base import query, quoted, table
from claimloom.resources.words import BOILERPLATE, MEDIA, NOT_NEWS, STOP_WORDS

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ASCII = r"regexp_replace({}, '[^\x00-\x7F]', '', 'g')"
_SMART = "translate({}, '‘’“”，', '''''\"\",')"
_EMAIL = r"regexp_replace({}, '[\w.-]+@[\w.-]+', '_EMAIL_', 'g')"
_LINKS = r"regexp_replace(regexp_replace({}, 'http\S*([.,])(\s|$)', '_LINKS_\1\2', 'g'), 'http\S+', '_LINKS_', 'g')"
_MARKS = r"regexp_replace({}, '\?(\w+)\? | (\w+)\?\w+', '\1\2', 'g')"
_WORDS = r"regexp_extract_all({}, '\S+')"
_COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _moji(x: str) -> str:
    for a, b in T.MOJIBAKE:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def _bracketed(x: str) -> str:
    head = f"array_to_string(list_slice({_WORDS.format(x)}, 1, 10), ' ')"
    for p in (r"\(\w+\)", r"\[\w+\]"):
        found = f"regexp_extract({head}, '{p}')"
        x = f"CASE WHEN {found} <> '' THEN replace({x}, {found}, '') ELSE {x} END"
    return x


_CLEAN = _MARKS.format(_LINKS.format(_EMAIL.format(_ASCII.format(_moji(_SMART.format("text"))))))
_NOT_STOP = [w for w in STOP_WORDS if w not in ("not", "can")]
_BERT = _COLLAPSE.format("text")
_BERT = f"replace(replace({_BERT}, '&amp;', '&'), '''t', ' not')"
_BERT = rf"regexp_replace({_BERT}, '@.*?\s', ' ', 'g')"
_BERT = rf"""regexp_replace({_BERT}, '([''\".()!?\\/,])', ' \1 ', 'g')"""
_BERT = rf"regexp_replace({_BERT}, '[^\p{{L}}\p{{N}}_\s?]', ' ', 'g')"

_TEXT = {
    "txt_01_clean_str": (T.clean_str, "lower(" + _STRIP.format(r"regexp_replace(text, '[^0-9A-Za-z\s]', '', 'g')") + ")"),
    "txt_02_clean_quotes": (T.clean_quotes, "lower(" + _STRIP.format(r"regexp_replace(text, '[\\''\"]', '', 'g')") + ")"),
    "txt_03_ascii_only": (T.ascii_only, _ASCII.format("text")),
    "txt_04_plain_quotes": (T.plain_quotes, _SMART.format("text")),
    "txt_05_mojibake": (T.fix_mojibake, _moji("text")),
    "txt_06_emails": (T.mask_emails, _EMAIL.format("text")),
    "txt_07_links": (T.mask_links, _LINKS.format("text")),
    "txt_08_question_marks": (T.question_marks, _MARKS.format("text")),
    "txt_09_bracketed": (T.drop_bracketed, _bracketed("text")),
    "txt_10_claim_example": (T.clean_claim_example, _STRIP.format("replace(text, 'SeeExample( s )', '')")),
    "txt_11_clean_text": (T.clean_text, None),
    "txt_12_paragraphs": (T.to_paragraphs, r"'<p>' || regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\n+', '</p><p>', 'g') || '</p>'"),
    "txt_13_from_paragraphs": (T.from_paragraphs, "regexp_replace(text, '</?p>', ' ', 'g')"),
    "txt_14_tabs": (T.drop_tabs, "replace(text, chr(9), '')"),
    "txt_15_collapse": (T.collapse, _COLLAPSE.format("text")),
    "txt_16_for_transformer": (T.for_transformer, f"array_to_string(list_filter({_WORDS.format(_BERT)}, lambda w: w NOT IN ({quoted(_NOT_STOP)})), ' ')"),
    "txt_17_for_topics": (T.for_topics, f"regexp_replace(array_to_string(list_filter({_WORDS.format('lower(text)')}, lambda w: w NOT IN ({quoted(STOP_WORDS)})), ' '), '[!-/:-@\\[-`{{-~]', '', 'g')"),
    "txt_18_lower_strip": (T.lower_strip, "lower(" + _STRIP.format("text") + ")"),
    "txt_19_subject": (T.subject, "substring(text, 1, 100)"),
    "txt_20_prefix": (T.prefix, "substring(text, 1, 7)"),
    "txt_21_shorten": (T.shorten, "CASE WHEN length(text) > 80 THEN substring(text, 1, 77) || '...' ELSE text END"),
    "txt_22_is_ascii": (T.is_ascii, r"NOT regexp_matches(text, '[^\x00-\x7F]')"),
    "txt_23_letters": (T.letters_only, "regexp_replace(lower(text), '[^a-z]', '', 'g')"),
    "txt_24_count_words": (T.count_words, r"CAST(len(regexp_extract_all(lower(text), '\S*[a-z]\S*')) AS BIGINT)"),
}


def _text(f):
    return lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", f("text").alias("result"))


for _name, (_f, _sql) in _TEXT.items():
    if _name == "txt_11_clean_text":
        query(_name, f"WITH c AS (SELECT doc_id, {_CLEAN} AS x FROM documents) SELECT doc_id, {_bracketed('x')} AS result FROM c")(_text(_f))
    else:
        query(_name, f"SELECT doc_id, {_sql} AS result FROM documents")(_text(_f))

_PHRASES = " OR ".join(f"contains(text, '{p.replace(chr(39), chr(39) * 2)}')" for p in BOILERPLATE)
_N = r"len(regexp_extract_all(lower(text), '\S*[a-z]\S*'))"


@query("flt_01_length", f"SELECT doc_id FROM documents WHERE {_N} >= 100 AND {_N} < 30000")
def flt_01(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(filters.right_length("text")).select("doc_id")


@query("flt_02_combined_length", r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\S+')) > 40 AND length(text) < 30000")
def flt_02(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter((F.size(T.words("text")) > 40) & (F.length("text") < 30000)).select("doc_id")


@query("flt_03_boilerplate", f"SELECT doc_id, ({_PHRASES}) AS unwanted FROM documents")
def flt_03(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", filters.boilerplate("text").alias("unwanted"))


@query("flt_06_site_cleaner", f"WITH k AS (SELECT doc_id, {_CLEAN} AS x FROM documents WHERE {_N} >= 100 AND {_N} < 30000 AND NOT ({_PHRASES})) SELECT doc_id, {_bracketed('x')} AS text FROM k")
def flt_06(spark, sf_dir):
    return filters.clean_site(table(spark, sf_dir, "documents"), "text").select("doc_id", "text")


@query("flt_07_web_cleaner", f"WITH k AS (SELECT doc_id, text AS raw, {_CLEAN} AS x, {_N} >= 100 AND {_N} < 30000 AND NOT ({_PHRASES}) AS ok FROM documents) SELECT doc_id, CASE WHEN ok THEN {_bracketed('x')} ELSE raw END AS text FROM k")
def flt_07(spark, sf_dir):
    return filters.clean_site(table(spark, sf_dir, "documents"), "text", mode="web").select("doc_id", "text")


@query("flt_11_large_sources", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) > 20)")
def flt_11(spark, sf_dir):
    return filters.of_large_groups(table(spark, sf_dir, "documents"), "source", 20).select("doc_id")


@query("flt_13_discard_labels", "SELECT doc_id FROM labels WHERE NOT (quality = 0 AND toxic = 1)")
def flt_13(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter(~((F.col("quality") == 0) & (F.col("toxic") == 1))).select("doc_id")


@query(
    "agg_12_funnel",
    rf"""WITH base AS (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS r FROM documents),
    u AS (SELECT text, len(regexp_extract_all(text, '\S+')) > 40 AS long_enough, length(text) < 30000 AS short_enough, ({_PHRASES}) AS unwanted, NOT regexp_matches(text, '[^\x00-\x7F]') AS plain FROM base WHERE r = 1)
    SELECT (SELECT count(*) FROM documents) AS with_duplicates, count(*) AS without_duplicates, (SELECT count(*) FROM documents) - count(*) AS duplicates,
      count(*) FILTER (NOT long_enough) AS short_text, count(*) FILTER (long_enough AND NOT short_enough) AS long_text,
      count(*) FILTER (long_enough AND short_enough AND unwanted) AS unwanted_text, count(*) FILTER (long_enough AND short_enough AND NOT unwanted AND NOT plain) AS non_ascii FROM u""",
)
def agg_12(spark, sf_dir):
    return filters.funnel(table(spark, sf_dir, "documents"), "text", ["source", "text"], "doc_id")


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


def _pages(name, column, sql):
    @query(name, f"SELECT page_id, {sql} AS result FROM pages")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "pages").select("page_id", column().alias("result"))


_ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"

_pages("htm_01_text", lambda: W.get_text("html"), _COLLAPSE.format(_ENTITIES.format(_STRIPPED)))
_pages("htm_02_section", lambda: W.section("html", "h1", "p"), r"trim(regexp_extract(html, '(?is)<h1[^>]*>[^<]*</h1>\s*<p[^>]*>(.*?)</p>', 1))")
_pages("htm_05_anchors", lambda: W.anchors("html"), "regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)")
_pages("htm_06_title", lambda: W.inner("html", "title"), "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_pages("htm_06_after_words", lambda: W.after_words(W.inner("html", "title"), 2), r"array_to_string(list_slice(regexp_extract_all(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\S+'), 3, -1), ' ')")
_pages("htm_07_tags", lambda: F.array_join(W.anchor_texts("html"), "&"), "array_to_string(regexp_extract_all(html, '<a[^>]*>([^<]*)</a>', 1), '&')")
_pages("url_01_netloc", lambda: W.netloc("url"), _HOST)
_pages("url_02_domain", lambda: W.registered_domain("url"), rf"regexp_extract(regexp_replace(regexp_replace({_HOST}, '^.*@', ''), ':\d+$', ''), '([^.]+\.)?[^.]+$')")
_pages("url_03_name", lambda: W.output_name("url"), r"replace(regexp_replace(url, '^https?://[^/?#]*/?', ''), '/', '_')")
_pages("url_04_media", lambda: W.is_media("url"), " OR ".join(f"contains(lower(url), '{m}')" for m in MEDIA))
_pages("url_05_not_news", lambda: W.not_news("url"), " OR ".join(f"contains(url, '{m}')" for m in NOT_NEWS))
_pages("url_06_debunker", lambda: T.from_debunker("url"), "contains(url, 'snope') OR contains(url, 'politifact')")

_OUT = r"""WITH p AS (SELECT page_id, url, list_slice(string_split(html, '<p>'), 2, -1) AS parts FROM pages),
  e AS (SELECT page_id, url, i, regexp_extract_all(parts[i], '<a[^>]*href="([^"]*)"', 1) AS hrefs FROM (SELECT page_id, url, parts, unnest(range({low}, len(parts) + 1)) AS i FROM p))"""


@query("htm_03_first_links", _OUT.format(low=1) + " SELECT page_id, i AS paragraph, unnest(hrefs) AS href FROM e WHERE i <= 2")
def htm_03(spark, sf_dir):
    return W.citations(table(spark, sf_dir, "pages")).filter("paragraph <= 2").select("page_id", "paragraph", "href")


@query("htm_04_citations", _OUT.format(low=2) + f", x AS (SELECT page_id, {_HOST} AS host, i - 1 AS paragraph, unnest(hrefs) AS href FROM e) SELECT page_id, paragraph, href FROM x WHERE NOT contains(href, host)")
def htm_04(spark, sf_dir):
    return W.citations(table(spark, sf_dir, "pages"), skip_first=True).filter(~F.contains("href", W.netloc("url"))).select("page_id", "paragraph", "href")


@query("htm_08_explode", "WITH a AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1) AS h FROM pages) SELECT page_id, CAST(i - 1 AS INTEGER) AS position, h[i] AS href, i = 1 AS is_first FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM a)")
def htm_08(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(W.anchors("html")).alias("position", "href"))
    return rows.withColumn("is_first", F.col("position") == 0)


_STATUS = f"""CASE WHEN text IS NULL OR text = '' THEN 'Resource moved' WHEN length({_COLLAPSE.format('text')}) > 32000 THEN 'Article too long'
  WHEN len(string_split({_COLLAPSE.format('text')}, ' ')) < 50 THEN 'Article too short' WHEN {' OR '.join(f"contains(source, '{m}')" for m in NOT_NEWS)} THEN 'Not a news article' ELSE 'No Error' END"""


@query("url_07_status", f"SELECT doc_id, {_STATUS} AS status FROM documents")
def url_07(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.article_status("text", "source").alias("status"))


@query("flt_04_no_error", f"SELECT doc_id FROM documents WHERE ({_STATUS}) = 'No Error'")
def flt_04(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(W.article_status("text", "source") == "No Error").select("doc_id")


@query("dat_01_timestamp", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def dat_01(spark, sf_dir):
    written = F.date_format("ts", "EEEE, MMMM d'th', yyyy 'at' h:mm a")
    return table(spark, sf_dir, "events").select("event_id", W.parse_timestamp(written).alias("day"))


@query("dat_02_cutoff", "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10'")
def dat_02(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.to_date("ts") >= F.lit("2024-01-10").cast("date")).select("event_id")


@query("dat_03_format", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def dat_03(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
