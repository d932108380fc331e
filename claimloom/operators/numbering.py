"""Consecutive numbers for rows in an order, without gathering them in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.storage import written


def numbered(rows: DataFrame, order, name: str = "row_id") -> DataFrame:
    """JON-03: 1.. in the order of a unique column, or of several that are unique together.

    Rows are sorted over range partitions and saved with their places within
    them; a row a partition tells how many come before.  They are saved since
    the bounds of the ranges come from a sample: computed anew for other
    columns, rows would fall into other partitions than were counted.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, so that it is not changed at run time
    by = order if isinstance(order, (list, tuple)) else [order]
    dealt = written(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_i", F.monotonically_increasing_id()))
    placed = dealt.withColumn("_p", F.shiftright("_i", 33)).withColumn("_r", F.col("_i").bitwiseAND((1 << 33) - 1) + 1)  # partition, place
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    joined = placed.join(F.broadcast(before), "_p")  # a row a partition
    return joined.withColumn(name, F.col("_before") + F.col("_r")).drop("_p", "_before", "_r", "_i")


def numbered_within(rows: DataFrame, groups: list[str], order: list, name: str = "_r", size: str = "_f") -> DataFrame:
    """1.. within each group, in an order that is unique there, and the group's number of rows.

    A group's rows follow each other in the order of all rows, so a group of
    any size is spread over many tasks; a row a group tells where it begins.
    """
    every = numbered(rows, [*groups, *order], "_all")
    begins = every.groupBy(*groups).agg((F.min("_all") - 1).alias("_begin"), F.count("*").alias(size))
    begins = begins.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], "_begin", size)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(groups)])
    return every.join(begins, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_all") - F.col("_begin")).alias(name), size)


def running(rows: DataFrame, order, sums: list[str]) -> DataFrame:
    """``rows`` with the sums of columns up to each row (``upto_*``) and over all rows (``all_*``), in the order of a unique column.

    Windows run within range partitions, which are saved; a row a partition
    tells what stands before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()))
    totals = dealt.groupBy("_p").agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(sums)])
    before, every = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    base = totals.select("_p", *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))], *[F.sum(f"_t{k}").over(every).alias(f"all_{c}") for k, c in enumerate(sums)])
    within = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(base), "_p")  # a row a partition
    upto = [(F.col(f"_b{k}") + F.sum(c).over(within)).alias(f"upto_{c}") for k, c in enumerate(sums)]
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], *upto, *[f"all_{c}" for c in sums])
