"""A keyed snapshot that a stream keeps: a batch rewrites only the buckets that its keys fall into.

Keys are hashed to ``buckets`` folders, a number that stays for the life of the
snapshot.  Batch n writes the touched buckets under ``data/v{n}`` and then a
list of all buckets with the batch that wrote each, ``buckets/v{n}``; readers
take the newest list that is complete.  A batch without a complete list is
written anew from what the list before names; one with a list is not, so files
that a list names are never written over, and a batch that is tried again, by a
lost driver's successor too, changes nothing.  A snapshot belongs to the
checkpoint of one stream.

Of a key's rows the one with the largest order column stays, so rows that come
late do not replace newer ones, and batches in any order end in one answer; of
rows equal in the order column the one greatest in all columns stays.  A null key is a key;
a null order is the least.  Lists and files that only lists older than the
newest ``keep`` name are deleted: ``keep`` is how many batches a reader may take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """INC-02: a row a key, by partial aggregates."""
    others = [c for c in rows.columns if c not in (key, order)]
    whole = F.struct(F.col(f"`{order}`"), *[F.col(f"`{c}`") for c in others])
    best = rows.groupBy(F.col(f"`{key}`").alias(key)).agg(F.max(whole).alias("_best"))
    return best.select(*[F.col(f"`{c}`") if c == key else F.col("_best").getField(c).alias(c) for c in rows.columns])


def _folder(spark: SparkSession, path: str):
    """(file system, path) of the cluster's file layer."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, path: str) -> list[int]:
    """The batches with a complete list, rising."""
    fs, at = _folder(spark, f"{path}/buckets")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [int(n[1:]) for n in names if n.startswith("v") and fs.exists(_folder(spark, f"{path}/buckets/{n}/_SUCCESS")[1])]
    return sorted(done)


def _named(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """The batch that wrote each bucket, as list n has it: at most one entry a bucket."""
    return {r.bucket: r.batch for r in spark.read.schema("bucket int, batch long").parquet(f"{path}/buckets/v{n}").collect()}


def _rows(spark: SparkSession, path: str, named: dict[int, int], schema) -> DataFrame:
    if not named:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/v{n}/_bucket={b}" for b, n in sorted(named.items())])


def merge(batch: DataFrame, n: int, path: str, key: str, order: str, buckets: int = 64, keep: int = 2) -> None:
    """Batch ``n`` (from 0, rising) into the snapshot at ``path``."""
    spark = batch.sparkSession
    before = _listed(spark, path)
    if before and before[-1] == n:  # it ended, and its stream did not get to know
        return
    if before and before[-1] > n:
        raise ValueError(f"{path} holds batch {before[-1]}, so batch {n} is another stream's")
    named = _named(spark, path, before[-1]) if before else {}
    place = F.pmod(F.hash(F.col(f"`{key}`")), F.lit(buckets)).alias("_bucket")
    rows = newest(batch, key, order).select(place, *[F.col(f"`{c}`") for c in batch.columns]).persist()
    try:
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
        old = _rows(spark, path, {b: named[b] for b in touched if b in named}, batch.schema)
        both = newest(old.unionByName(rows.drop("_bucket")), key, order).select(place, *[F.col(f"`{c}`") for c in batch.columns])
        both.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v{n}")
    finally:
        rows.unpersist()
    named |= dict.fromkeys(touched, n)
    spark.createDataFrame(sorted(named.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets/v{n}")
    _forget(spark, path, keep)


def _forget(spark: SparkSession, path: str, keep: int) -> None:
    """INC-03: lists before the newest ``keep``, and buckets that none of those names."""
    lists = _listed(spark, path)
    kept, gone = lists[-max(1, keep) :], lists[: -max(1, keep)]
    used = {(n, b) for m in kept for b, n in _named(spark, path, m).items()}
    for m in gone:
        for b, n in _named(spark, path, m).items():
            if (n, b) not in used:
                fs, at = _folder(spark, f"{path}/data/v{n}/_bucket={b}")
                fs.delete(at, True)
        fs, at = _folder(spark, f"{path}/buckets/v{m}")
        fs.delete(at, True)


def snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the newest complete batch; none before the first."""
    lists = _listed(spark, path)
    return _rows(spark, path, _named(spark, path, lists[-1]) if lists else {}, schema)


def kept(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, buckets: int = 64, keep: int = 2):
    """INC-02: the stream into the snapshot at ``path``, all that has come; returns the query."""
    step = lambda batch, n: merge(batch, n, path, key, order, buckets, keep)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
