"""Registered domains by a table of public suffixes: the longest rule that a host ends with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import web as W


def registered(rows: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """URL-02: ``rows`` with ``host``, ``suffix`` and ``domain``, the suffix and the label before it.

    ``suffixes`` has a column ``rule``: ``co.uk``; ``*.ck`` for any label before
    ``ck``; ``!www.ck`` for a host that such a rule leaves out.  An exception
    wins, then the longest rule; without any the last label is the suffix.  A
    host that is itself a suffix, an address of numbers, and a URL without a
    host have no domain ('').  Each host is looked up once.
    """
    host = F.regexp_replace(F.regexp_replace(F.lower(W.netloc(url)), "^.*@", ""), r":\d*$", "")
    host = F.coalesce(F.regexp_replace(host, "[.]$", ""), F.lit(""))
    named = rows.withColumn("host", host)
    labels = F.split("host", "[.]")
    n = F.size("labels")
    hosts = named.select("host").distinct().filter(r"host <> '' AND NOT host RLIKE '^[0-9.]+$|:'").withColumn("labels", labels)
    tail = lambda i: F.array_join(F.slice("labels", i, n), ".")
    keys = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.array(
                F.struct(tail(i).alias("rule"), (n - i + 1).alias("size"), F.lit(False).alias("out")),
                F.struct(F.concat(F.lit("*."), F.when(i < n, tail(i + 1)).otherwise("")).alias("rule"), (n - i + 1).alias("size"), F.lit(False).alias("out")),
                F.struct(F.concat(F.lit("!"), tail(i)).alias("rule"), (n - i).alias("size"), F.lit(True).alias("out")),
            ),
        )
    )
    met = hosts.select("host", F.inline(keys)).join(suffixes.select("rule").distinct(), "rule").groupBy("host").agg(F.max_by("size", F.struct("out", "size")).alias("size"))
    size = F.coalesce("size", F.lit(1))
    known = hosts.join(met, "host", "left").select(
        "host",
        F.array_join(F.slice("labels", n - size + 1, size), ".").alias("suffix"),
        F.when(size < n, F.array_join(F.slice("labels", n - size, size + 1), ".")).otherwise("").alias("domain"),
    )
    every = named.join(known, "host", "left")
    return every.select(*[F.col(f"`{c}`") for c in rows.columns], "host", F.coalesce("suffix", F.lit("")).alias("suffix"), F.coalesce("domain", F.lit("")).alias("domain"))
