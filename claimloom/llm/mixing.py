"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken ``target / source_size`` times.  The
whole part is settled; the fractions are rounded in pairs.  A pair moves words
between its two documents, as many as make one of them whole, to either side
with the chance that keeps both expectations; so a source's words stay as
they are until its last document is rounded.  Pairs are folded within groups
of about ``FAN`` documents, and the groups' residuals are folded in groups
again, a level of the tree at a time, so no group grows with the input.  Long
documents are folded first, so that a short one is left; the last of a source
goes to the nearer side.

All of it is DataFrame operations.  Chances come from hashes of doc_ids, so
reruns agree.

Sizes are numbers of words; a null text has none, is never taken, and counts
in its source.  A null source is a source of its own, sorted last.  Sources
without words have target 0.  Repeated rows are documents of their own and
interchangeable.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, own_column, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights by a source's rank in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
FAN, SALTS = 64, 64
SEED = 20240607


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, none, size): ``none`` tells the null source, whose source is ''."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNull().alias("none"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """(source, none, source_size, n, target): a row a source.

    A source stops at its cap iff the water level that fills it does not use
    up the total.  The windows run over one row a source.
    """
    per = sizes.groupBy("source", "none").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy("none", "source")
    by_level = Window.orderBy("level", "none", "source")
    upto, after = by_level.rowsBetween(Window.unboundedPreceding, 0), by_level.rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("none", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int"))
    with_level = (
        per.withColumn("weight", weight)
        .withColumn("total", SHARE * F.sum("source_size").over(every))
        .withColumn("cap", MOST * F.col("source_size"))
        .withColumn("level", F.col("cap") / F.col("weight"))
    )
    filled = F.sum("cap").over(upto) + F.col("level") * F.coalesce(F.sum("weight").over(after), F.lit(0.0))
    capped = with_level.withColumn("capped", filled <= F.col("total"))
    used = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    share = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(every)
    level = F.try_divide(F.col("total") - used, share)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level))
    return capped.select("source", "none", "source_size", "n", target.alias("target"))


#: One step of the fold: x is held with fraction p, y comes in.  Words move from
#: y to x (``up``) or from x to y; one of them becomes whole and is done.
_FOLD = """
aggregate(slice(items, 2, greatest(size(items) - 1, 0)),
  named_struct('held', items[0], 'done', cast(array() as array<struct<size:bigint,h:bigint,doc_id:bigint,p:double>>)),
  (s, y) -> if(s.held.p <= 0 or s.held.p >= 1,
    named_struct('held', y, 'done', array_append(s.done, s.held)),
    transform(array(named_struct(
        'gain', least(s.held.size * (1 - s.held.p), y.size * y.p),
        'loss', least(s.held.size * s.held.p, y.size * (1 - y.p)),
        'u', (xxhash64(s.held.h, y.h, s.held.doc_id, y.doc_id, {seed}) & 9007199254740991) / 9007199254740992D)), w ->
      if(w.u * (w.gain + w.loss) < w.loss,
        if(s.held.size * (1 - s.held.p) <= y.size * y.p,
          named_struct('held', named_struct('size', y.size, 'h', y.h, 'doc_id', y.doc_id, 'p', greatest(0D, y.p - w.gain / y.size)),
                       'done', array_append(s.done, named_struct('size', s.held.size, 'h', s.held.h, 'doc_id', s.held.doc_id, 'p', 1D))),
          named_struct('held', named_struct('size', s.held.size, 'h', s.held.h, 'doc_id', s.held.doc_id, 'p', least(1D, s.held.p + w.gain / s.held.size)),
                       'done', array_append(s.done, named_struct('size', y.size, 'h', y.h, 'doc_id', y.doc_id, 'p', 0D)))),
        if(s.held.size * s.held.p <= y.size * (1 - y.p),
          named_struct('held', named_struct('size', y.size, 'h', y.h, 'doc_id', y.doc_id, 'p', least(1D, y.p + w.loss / y.size)),
                       'done', array_append(s.done, named_struct('size', s.held.size, 'h', s.held.h, 'doc_id', s.held.doc_id, 'p', 0D))),
          named_struct('held', named_struct('size', s.held.size, 'h', s.held.h, 'doc_id', s.held.doc_id, 'p', greatest(0D, s.held.p - w.loss / s.held.size)),
                       'done', array_append(s.done, named_struct('size', y.size, 'h', y.h, 'doc_id', y.doc_id, 'p', 1D)))))
    )[0]),
  s -> array_append(s.done, s.held))
"""


def decide(docs: DataFrame) -> DataFrame:
    """(doc_id, source, none, size, source_size, target, copies): how often each document is taken."""
    sizes = materialise(sized(docs), "mixing-sizes")
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS))
    salted = materialise(targets(sizes), "mixing-targets")
    most = salted.agg(F.max("n")).first()[0] or 0
    salted = salted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    keys = ["source", "none", "source_size", "target", "n", "whole"]
    rows = (
        sizes.withColumn("salt", salt)
        .join(salted, ["source", "none", "salt"])
        .withColumn("whole", F.floor(rate).cast("long"))
        .select(*keys, F.xxhash64("doc_id", "size", F.lit(SEED)).alias("h"), "doc_id", "size", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("p"))
    )
    settled, level, groups = [], 0, most
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        groups = max(1, math.ceil(groups / FAN))
        bucket = F.pmod(F.xxhash64("h", "doc_id", F.lit(SEED + level)), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(FAN) ** (level + 1)))).cast("long"))
        folded = (
            rows.filter(open_)
            .groupBy(*keys, bucket.alias("bucket"))
            .agg(F.sort_array(F.collect_list(F.struct("size", "h", "doc_id", "p")), asc=False).alias("items"))
            .select(*keys, F.explode(F.expr(_FOLD.format(seed=SEED + level))).alias("i"))
            .select(*keys, "i.h", "i.doc_id", "i.size", "i.p")
        )
        settled.append(rows.filter(~open_))
        rows = materialise(folded, f"mixing-level{level}")
        level += 1
        if groups == 1:
            break
    settled.append(rows.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(0)
    return out.select("doc_id", "source", "none", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as it is taken.

    Rows that agree in doc_id, source and size are interchangeable: the k-th
    gets the k-th of their decisions.
    """
    decided = decide(docs).groupBy("doc_id", "source", "none", "size").agg(F.array_sort(F.collect_list("copies")).alias("_copies"))
    keyed = docs.select(*[own_column(c).alias(f"_d{k}") for k, c in enumerate(docs.columns)])
    at = {c: f"_d{k}" for k, c in enumerate(docs.columns)}
    keyed = keyed.select(
        *at.values(),
        F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(0)).alias("_id"),
        F.col(at["doc_id"]).isNull().alias("_no_id"),
        F.coalesce(at["source"], F.lit("")).alias("_source"),
        F.col(at["source"]).isNull().alias("_none"),
        F.coalesce(F.regexp_count(at["text"], F.lit(WORDS)), F.lit(0)).cast("long").alias("_size"),
    )
    same = ["_id", "_no_id", "_source", "_none", "_size"]
    decided = decided.select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no_id"),
        F.col("source").alias("_source"), F.col("none").alias("_none"), F.col("size").alias("_size"), "_copies",
    )
    joined = keyed.join(decided, same).withColumn("_k", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64(at["text"]))))
    copies = F.element_at("_copies", F.col("_k")).cast("int")
    taken = joined.withColumn("_copy", F.explode(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), copies)))
    return taken.select(*[F.col(v).alias(k) for k, v in at.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    d = decide(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
