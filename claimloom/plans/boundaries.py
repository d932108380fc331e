"""Queries of sentences by learned abbreviations and of domains by suffix rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import domains
from claimloom.operators import sentences as S
from claimloom.plans.base import query, quoted, table
from claimloom.plans.cleaning import _HOST
from claimloom.resources.words import SUFFIXES

_SQL_ENDS, _SQL_BEFORE = S.ENDS.replace("'", "''"), S.BEFORE_PERIOD.replace("'", "''")
_COUNTS = f"""w AS (SELECT unnest(regexp_extract_all(lower(text), '{S.WORD}[.]?')) AS w FROM documents),
 c AS (SELECT CASE WHEN ends_with(w, '.') THEN left(w, length(w) - 1) ELSE w END AS term, count(*) FILTER (ends_with(w, '.')) AS a, count(*) FILTER (NOT ends_with(w, '.')) AS b FROM w GROUP BY 1),
 t AS (SELECT sum(a)::DOUBLE / sum(a + b) AS p FROM c),
 s AS (SELECT term, a, b, length(term) - length(replace(term, '.', '')) AS inside, length(replace(term, '.', '')) AS signs,
   -2 * (a * (ln(p) - ln({S.SURE})) + b * (ln(greatest(1 - p, 1e-12)) - ln({1 - S.SURE}))) AS ratio FROM c, t WHERE a > 0 AND regexp_matches(term, '\\p{{L}}')),
 x AS (SELECT term, a AS with_period, b AS without, ratio * exp(-signs) * (inside + 1) * pow(signs::DOUBLE, -b::DOUBLE) AS score FROM s)"""
_SPLIT = rf"""d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '\S+'), []) AS w FROM documents),
 e AS (SELECT doc_id, w[p] AS word, p, coalesce(w[p + 1], '') AS after FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d)),
 f AS (SELECT doc_id, p, regexp_extract(lower(word), '{_SQL_BEFORE}', 1) AS term FROM e WHERE regexp_matches(word, '{_SQL_ENDS}') AND NOT regexp_matches(after, '^["''(\[]*\p{{Ll}}')),
 g AS (SELECT doc_id, p FROM f WHERE NOT regexp_matches(term, '^\p{{L}}$') AND term NOT IN (SELECT term FROM x WHERE score >= {S.LEAST}) UNION SELECT doc_id, len(w) FROM d WHERE len(w) > 0),
 h AS (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), 0) AS q FROM g),
 k AS (SELECT h.doc_id, list(array_to_string(w[q + 1:p], ' ') ORDER BY p) AS sentences FROM h JOIN d ON d.doc_id = h.doc_id GROUP BY h.doc_id)"""


def _abbreviations(spark, sf_dir):
    return S.abbreviations(S.period_counts(table(spark, sf_dir, "documents")))


@query("tok_05_abbreviations", f"WITH {_COUNTS} SELECT term, with_period, without, round(score, 6) + 0 AS score, score >= {S.LEAST} AS abbreviation FROM x")
def tok_05_abbreviations(spark, sf_dir):
    return _abbreviations(spark, sf_dir).withColumn("score", F.round("score", 6) + 0)  # no negative zero


@query("tok_05_learned_sentences", f"WITH {_COUNTS}, {_SPLIT} SELECT d.doc_id, coalesce(sentences, []) AS sentences FROM d LEFT JOIN k ON k.doc_id = d.doc_id")
def tok_05_learned_sentences(spark, sf_dir):
    return S.split(table(spark, sf_dir, "documents"), _abbreviations(spark, sf_dir).filter("abbreviation"))


#: Suffixes under which the pages at hand give out names, besides the public ones.
PRIVATE = ("example.com", "*.example.net", "!blog.tionsh.example.net")
_TAIL = "array_to_string(l[i:], '.')"


@query(
    "url_02_registered",
    f"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(lower({_HOST}), '^.*@', ''), ':[0-9]*$', '') AS host FROM pages),
 l AS (SELECT page_id, host, string_split(host, '.') AS l FROM h), p AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l),
 r AS (SELECT unnest([{quoted((*SUFFIXES, *PRIVATE))}]) AS rule),
 m AS (SELECT page_id, len(l) - i + 1 AS n, false AS out FROM p WHERE {_TAIL} IN (FROM r) OR concat('*.', array_to_string(l[i + 1:], '.')) IN (FROM r)
   UNION ALL SELECT page_id, len(l) - i, true FROM p WHERE concat('!', {_TAIL}) IN (FROM r)),
 b AS (SELECT page_id, arg_max(n, (out, n)) AS n FROM m GROUP BY page_id),
 s AS (SELECT l.page_id, host, l, coalesce(n, 1) AS n FROM l LEFT JOIN b ON b.page_id = l.page_id)
 SELECT page_id, host, array_to_string(l[len(l) - n + 1:], '.') AS suffix, CASE WHEN n < len(l) THEN array_to_string(l[len(l) - n:], '.') ELSE '' END AS domain FROM s""",
)
def url_02_registered(spark, sf_dir):
    rules = spark.createDataFrame([(r,) for r in (*SUFFIXES, *PRIVATE)], "rule string")  # a user's whole list takes its place
    return domains.registered(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")
