"""Personal data: pattern spans, then information-theoretic sanitisation.

Pattern spans (e-mail, IP, card, phone) are found in the whole text.  Their
values are the protected entities.
A term near a mention of an entity reveals it as far as their pointwise mutual
information in the corpus reaches the entity's information content:

    PMI(e; t) = log2(N * df(e, t) / (df(e) * df(t))),   IC(e) = log2(N / df(e))

and is revealing if PMI >= DISCLOSURE * IC.  N, df(t) and df(e) count distinct
texts, df(e, t) distinct texts in which t stands within REACH words of e.
There are two entities to a mention: its value, where a pair needs SUPPORT
texts, and its kind (any e-mail, any card), which gives evidence for values
that stand in one text only.  For a kind the share df(e, t) / df(t) is smoothed
by PRIOR texts at the kind's own rate, (df(e, t) + PRIOR * df(e) / N) /
(df(t) + PRIOR), since one text alone can't tell a term that reveals from one
that happens to stand there.

Every occurrence of a revealing term in any text, outside pattern spans, is a
span of kind ``term``.  ``sanitise`` replaces pattern spans by their kind and
generalises revealing terms to a class (number, name) or, for plain words,
removes them.

Null text: no spans.  Repeated rows are treated each and count once in the
corpus.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, own_column, prepare, steadily, table, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
NOT_DIGIT = re.compile(r"[^0-9]+")
REACH, SUPPORT, DISCLOSURE, PRIOR = 8, 3, 0.9, 1.0
#: Terms shorter than this say nothing about anyone.
MIN_TERM = 3
#: Terms whose list goes to tasks at most; beyond, they are joined.
LISTED = 500_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of e-mail addresses, found from their signs, so that long runs of letters cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern kinds, by start, then kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """The protected value that a span mentions, whatever its writing."""
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else NOT_DIGIT.sub('', value)}"


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words within REACH words of each span, none that overlaps a span."""
    if not spans:
        return []
    words, at, end = [], 0, 0
    for m in WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            end = max(end, spans[at][2])
            at += 1
        words.append((m.start(), m.end(), m.start() < end))
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    out = []
    for start, kind, end in spans:
        e = entity(kind, text[start:end])
        before, after = bisect.bisect_right(ends, start), bisect.bisect_left(starts, end)
        for s, t, covered in (*words[max(0, before - REACH) : before], *words[after : after + REACH]):
            if t - s >= MIN_TERM and not covered:
                out.append((e, text[s:t].lower(), s, t))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, key (of the text), its pattern spans, what they mention, the words near them."""
    prepare(docs.sparkSession)
    schema = "doc_id long, key binary, spans array<struct<start:int,kind:int,end:int>>, mentioned array<string>, near array<struct<entity:string,term:string,start:int,end:int>>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                keys, spans, mentioned, near = [], [], [], []
                for text in batch.column(1).to_pylist():
                    found = pattern_spans(text)
                    spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                    mentioned.append(sorted({entity(k, text[s:e]) for s, k, e in found} | {KINDS[k] for _, k, _ in found}))
                    near.append([dict(zip(("entity", "term", "start", "end"), x, strict=True)) for x in contexts(text, found)])
                    keys.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                arrays = [batch.column(0), pa.array(keys, pa.binary()), pa.array(spans, span_type), pa.array(mentioned, pa.list_(pa.string())), pa.array(near, near_type)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "spans", "mentioned", "near"])

    return texts(docs).mapInArrow(steadily(run), schema)


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): distinct texts of the corpus that hold each of ``terms`` (saved).

    Words of each distinct text are counted in bounded maps that are sent on when full.  Up to ``LISTED`` terms, tasks have the
    list and count no other word; beyond, all words are counted and joined.
    """
    few = terms.count() <= LISTED
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in terms.toLocalIterator()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        wanted = shared.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = WORD.findall(text.lower())
                seen.update(set(words) if wanted is None else wanted.intersection(words))
                if len(seen) > 200_000:
                    yield pa.RecordBatch.from_pydict({"term": list(seen), "df": list(seen.values())})
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_pydict({"term": list(seen), "df": list(seen.values())})

    distinct = texts(docs).groupBy(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s")).agg(F.first("text").alias("text")).select("text")
    counted = distinct.mapInArrow(steadily(run), "term string, df long")
    counted = counted if few else counted.join(terms, "term", "left_semi")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def revealing(docs: DataFrame, scanned: DataFrame, reach: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(term) whose mutual information with a value or a kind of values reaches the disclosure threshold."""
    mentions = scanned.filter(F.size("near") > 0).select("key", F.explode("near").alias("m")).select("key", "m.entity", "m.term")
    kinds = mentions.withColumn("entity", F.substring_index("entity", ":", 1))  # of a value, the entity has more after it
    mentions = materialise(mentions.unionByName(kinds).distinct(), "pii-mentions")
    by_value = F.col("entity").contains(":")
    pairs = mentions.groupBy("entity", "term").agg(F.count("*").alias("both")).filter(~by_value | (F.col("both") >= support))
    entities = scanned.select("key", F.explode("mentioned").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("df_entity"))
    n = F.lit(float(scanned.select("key").distinct().count()))
    prior = F.when(by_value, 0.0).otherwise(PRIOR)

    def told(df: Column) -> Column:
        pmi = F.log2((F.col("both") + prior * F.col("df_entity") / n) / (df + prior) * n / F.col("df_entity"))
        return (pmi >= reach * F.log2(n / F.col("df_entity"))) & (pmi > 0)

    # a term stands in as many texts at least as near the entity: pairs that would not tell then are not counted in the corpus
    pairs = materialise(pairs.join(entities, "entity").filter(told(F.col("both"))), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("term")
    terms = term_frequencies(docs, materialise(pairs.select("term").distinct(), "pii-candidates"))
    return pairs.join(terms, "term").filter(told(F.col("df"))).select("term").distinct()


def mark(docs: DataFrame, told: frozenset[str]) -> DataFrame:
    """(doc_id, key, spans, terms) of each document, terms at every word in ``told`` that overlaps no span."""
    schema = "doc_id long, key binary, spans array<struct<start:int,kind:int,end:int>>, terms array<struct<start:int,end:int>>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    term_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(told)

    def occurrences(text: str, found: list[tuple[int, int, int]], told: frozenset[str]) -> list[dict]:
        out, at, end = [], 0, 0
        for m in WORD.finditer(text) if told else ():
            while at < len(found) and found[at][0] < m.end():
                end = max(end, found[at][2])
                at += 1
            if m.start() >= end and m[0].lower() in told:
                out.append({"start": m.start(), "end": m.end()})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                keys, spans, terms = [], [], []
                for text in batch.column(1).to_pylist():
                    found = pattern_spans(text)
                    spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                    terms.append(occurrences(text, found, told))
                    keys.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                arrays = [batch.column(0), pa.array(keys, pa.binary()), pa.array(spans, span_type), pa.array(terms, term_type)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "spans", "terms"])

    return texts(docs).mapInArrow(steadily(run), schema)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans, terms): pattern spans and revealing terms of each document."""
    scanned = materialise(scan(docs).select("key", "mentioned", "near"), "pii-scan")
    told = revealing(docs, scanned).toLocalIterator()  # no more than the vocabulary near protected values
    return mark(docs, frozenset(r.term for r in told))


def replacement(text: str, spans: list, terms: list) -> str:
    """The text with pattern spans as their kind, numbers and names generalised, other revealing words removed."""
    cuts = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in spans]
    for t in terms:
        word = text[t["start"] : t["end"]]
        cuts.append((t["start"], t["end"], "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else ""))
    out, at = [], 0
    for start, end, by in sorted(cuts):
        if start >= at:
            out += [text[at:start], by]
            at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the sanitised text in place of the text."""
    found = find(docs).filter((F.size("spans") > 0) | (F.size("terms") > 0)).groupBy("key").agg(F.first("spans").alias("spans"), F.first("terms").alias("terms"))

    @F.pandas_udf("binary")
    def key(text):
        return text.map(lambda t: hashlib.blake2b((t or "").encode(), digest_size=16).digest())

    @F.pandas_udf("string")
    def replaced(text, spans, terms):
        none = lambda x: [] if x is None else x
        return text.combine(spans, lambda t, s: (t, s)).combine(terms, lambda p, w: p[0] if p[0] is None else replacement(p[0], none(p[1]), none(w)))

    own = {c: "_text" if c == "text" else f"_c{k}" for k, c in enumerate(docs.columns)}  # none that clashes with ours
    rows = docs.select(*[own_column(c).alias(v) for c, v in own.items()]).withColumn("_key", key("_text"))
    joined = rows.join(found.select(F.col("key").alias("_key"), F.col("spans").alias("_spans"), F.col("terms").alias("_terms")), "_key", "left")
    return joined.select(*[replaced("_text", "_spans", "_terms").alias(c) if c == "text" else F.col(v).alias(c) for c, v in own.items()])


def _adds(kind: int):
    return lambda n, x: n + F.when(x.kind == kind, 1).otherwise(0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    base = F.transform("spans", lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x.kind + 1), x.start, x.end))
    every = F.transform(
        F.array_sort(
            F.concat(
                F.transform("spans", lambda x: F.struct(x.start.alias("a"), x.kind.alias("b"), x.end.alias("c"))),
                F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")), lambda x: F.struct(x.start.alias("a"), F.lit(len(KINDS)).alias("b"), x.end.alias("c"))),
            )
        ),
        lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, (*KINDS, "term"))), x.b + 1), x.a, x.c),
    )
    counts = [F.aggregate("spans", F.lit(0).cast("long"), _adds(k)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", every).alias("spans"))
