"""Queries that read pages as tables of elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import web as W
from claimloom.operators import markup as K
from claimloom.plans.base import query, table

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"
_ITEMS = f"i AS (SELECT page_id, url, unnest(range(1, len(x) + 1)) AS n, x FROM (SELECT page_id, url, regexp_extract_all({_NAV}, '<li>(.*?)</li>', 1) AS x FROM pages))"
_PLAIN = "replace(replace({}, '&quot;', '\"'), '&amp;', '&')"


def _read(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages, K.elements(pages)


@query("htm_01_elements", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY ALL")
def htm_01_elements(spark, sf_dir):
    return _read(spark, sf_dir)[1].groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("htm_02_beside", f"SELECT page_id, trim({_PLAIN.format(chr(39).join(['regexp_extract(html, ', '<div class="ad">([^<]*)</div>', ', 1)']))}) AS text FROM pages")
def htm_02_beside(spark, sf_dir):
    """What stands beside the navigation."""
    return K.section_held(K.held(table(spark, sf_dir, "pages")), "nav", lambda e: K.plain(K.text_of(e)))


@query("htm_02_after_title")
def htm_02_after_title(spark, sf_dir):
    """What stands beside the heading that repeats the page's title."""
    pages = K.first_held(K.held(table(spark, sf_dir, "pages")), "t", lambda e: e.tag == "title")
    return K.section_held(pages, "h1", lambda _: K.plain(K.text_of(F.col("t"))))


@query("htm_03_links_after", f"WITH {_ITEMS} SELECT page_id, n AS paragraph, regexp_extract(x[n], 'href=\"([^\"]*)\"', 1) AS href FROM i WHERE n <= 2")
def htm_03_links_after(spark, sf_dir):
    """Links of the first two items after the title."""
    _, rows = _read(spark, sf_dir)
    return K.links_after(rows, K.of(rows, "title"), "li").select("page_id", "paragraph", "href")


@query("htm_04_outbound", f"WITH {_ITEMS}, l AS (SELECT page_id, {_HOST} AS host, n - 1 AS paragraph, regexp_extract(x[n], 'href=\"([^\"]*)\"', 1) AS href FROM i WHERE n > 1) SELECT page_id, paragraph, href FROM l WHERE NOT contains(href, host)")
def htm_04_outbound(spark, sf_dir):
    """Links out of the navigation's items of pages with a heading, but for the first item."""
    pages, rows = _read(spark, sf_dir)
    return K.citations(rows, K.of(rows, "nav"), "li", K.of(rows, "h1"), pages.select("page_id", W.netloc("url").alias("site")))


@query("htm_06_info", f"SELECT page_id, trim({_PLAIN.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title, trim({_PLAIN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS heading, trim({_PLAIN.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")}) AS ad, '' AS claim FROM pages")
def htm_06_info(spark, sf_dir):
    """Page information by tag and class, '' where a page has none."""
    pages, rows = _read(spark, sf_dir)
    out = pages.select("page_id")
    for name, found in (("title", K.of(rows, "title")), ("heading", K.of(rows, "h1")), ("ad", K.of(rows, "div", "ad")), ("claim", K.of(rows, cls="claim"))):
        out = out.join(K.first_text(found, pages, name), "page_id")
    return out


@query("htm_07_joined", f"SELECT page_id, {_PLAIN.format(f"array_to_string(regexp_extract_all({_NAV}, '<a[^>]*>([^<]*)</a>', 1), '&')")} AS result FROM pages")
def htm_07_joined(spark, sf_dir):
    pages, rows = _read(spark, sf_dir)
    return K.joined_texts(rows, K.of(rows, "nav"), "a", pages)


@query("src_24_previews", f"SELECT page_id, regexp_extract({_NAV}, 'href=\"([^\"]*)\"', 1) AS href FROM pages")
def src_24(spark, sf_dir):
    """The first link of each list's first item."""
    return K.preview_links(_read(spark, sf_dir)[1], "ul", None, "li")
