"""A folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary one where it is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='claimloom-')}"
    return base.rstrip("/")


def written(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and saved, so that all readers see the same partitions."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def saved(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and saved as Parquet: smaller and faster for long tables than ``written``, but readers may part them anew."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/claimloom-tables/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(rows.schema).parquet(path)
