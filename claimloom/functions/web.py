"""HTML, URL and date extraction as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import col, collapse, words
from claimloom.resources.words import MEDIA, NOT_NEWS

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
HREF = '<a[^>]*href="([^"]*)"'


def get_text(c) -> Column:
    """HTM-01: without comments, scripts, styles and tags, entities decoded, white space collapsed."""
    out = col(c)
    for pattern in ("(?s)<!--.*?-->", "(?s)<script.*?</script>", "(?s)<style.*?</style>", "<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    return collapse(reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, out))


def section(c, heading: str, tag: str) -> Column:
    """HTM-02: the content of the ``tag`` that follows the heading."""
    return F.trim(F.regexp_extract(col(c), rf"(?is)<{heading}[^>]*>[^<]*</{heading}>\s*<{tag}[^>]*>(.*?)</{tag}>", 1))


def inner(c, tag: str) -> Column:
    """HTM-06: the first such element's content, '' if there is none."""
    return F.regexp_extract(col(c), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def after_words(c, k: int) -> Column:
    """HTM-06: without the first k words."""
    return F.array_join(F.slice(words(c), F.lit(k + 1), F.size(words(c)) + 1), " ")


def anchors(c) -> Column:
    """HTM-05."""
    return F.regexp_extract_all(col(c), F.lit(HREF), F.lit(1))


def anchor_texts(c) -> Column:
    """HTM-07."""
    return F.regexp_extract_all(col(c), F.lit("<a[^>]*>([^<]*)</a>"), F.lit(1))


def citations(pages: DataFrame, skip_first: bool = False) -> DataFrame:
    """HTM-03, HTM-04: a row a link of each paragraph, numbered from 1; the claim's paragraph may be left out."""
    split = F.split("html", "<p>")
    parts = F.slice(split, F.lit(3 if skip_first else 2), F.size(split) + 1)
    rows = pages.select("page_id", "url", F.posexplode(parts).alias("p", "part"))
    return rows.select("page_id", "url", (F.col("p") + 1).cast("long").alias("paragraph"), F.explode(anchors("part")).alias("href"))


def netloc(c) -> Column:
    """URL-01: '' where there is none."""
    return F.coalesce(F.try_parse_url(col(c), F.lit("AUTHORITY")), F.lit(""))


def registered_domain(c) -> Column:
    """URL-02: the host's last two labels (there is no list of public suffixes)."""
    host = F.regexp_replace(F.regexp_replace(netloc(c), "^.*@", ""), r":\d+$", "")
    return F.substring_index(host, ".", -2)


def output_name(c) -> Column:
    """URL-03."""
    return F.replace(F.regexp_replace(col(c), "^https?://[^/?#]*/?", ""), F.lit("/"), F.lit("_"))


def _any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def is_media(c) -> Column:
    """URL-04: by a part anywhere in the URL."""
    return _any(F.lower(col(c)), MEDIA)


def not_news(c) -> Column:
    """URL-05."""
    return _any(col(c), NOT_NEWS)


def article_status(text, url, short_rule: bool = True) -> Column:
    """URL-07: the first rule that a downloaded article breaks."""
    whole = collapse(text)
    out = F.when(col(text).isNull() | (col(text) == ""), "Resource moved").when(F.length(whole) > 32000, "Article too long")
    if short_rule:
        out = out.when(F.size(F.split(whole, " ")) < 50, "Article too short")
    return out.when(not_news(url), "Not a news article").otherwise("No Error")


def parse_timestamp(c) -> Column:
    """DAT-01: 'Monday, July 2nd, 2018 at ..' as a date."""
    plain = F.regexp_replace(col(c), r"^\w+,\s+(\w+)\s+(\d+)[a-z]+,\s+(\d{4}).*$", "$2 $1 $3")
    return F.to_date(plain, "d MMMM yyyy")
