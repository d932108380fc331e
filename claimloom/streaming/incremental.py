"""Incremental processing: high-water marks, merges of snapshots, append logs, streamed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.readers import merged


def newer(rows: DataFrame, seen: DataFrame, at: str) -> DataFrame:
    """INC-01: rows after the newest that was seen; all if none was."""
    mark = seen.agg(F.max(at).alias("_mark"))  # one row
    return rows.crossJoin(F.broadcast(mark)).filter(F.col("_mark").isNull() | (F.col(at) > F.col("_mark"))).drop("_mark")


def refresh(old: DataFrame, new: DataFrame, key: str, order: str, full: bool = False) -> DataFrame:
    """INC-02: merge by key; a full refresh takes the place of the old rows unless it is shorter."""
    if full:
        return new if new.count() >= old.count() else old
    return merged(old, new, key, order)


def daily_counts(events: DataFrame, at: str = "ts", by: str = "event_type", late: str = "1 day") -> DataFrame:
    """Counts by day; the same frame over a batch or, with a watermark, a stream."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, "1 day").alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), by, "n", "total")


def append_log(rows: DataFrame, path: str, checkpoint: str):
    """INC-04, INC-05: appends a stream of rows to a Parquet log, all that has come; returns the query."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str, order: str):
    """INC-02 as a stream: each batch is merged into the Parquet snapshot at ``path``; a repeated batch changes nothing.

    A batch's snapshot is a folder of its own, so that none is read while it is written over.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v{n - 1}"
        new = merged(spark.read.parquet(before), batch, key, order) if n else merged(batch.limit(0), batch, key, order)
        new.write.mode("overwrite").parquet(f"{path}/v{n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder as a stream with the schema of its files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
