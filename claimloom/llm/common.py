"""What the training-data operators share: inputs, scratch tables, worker set-up.

Scratch tables go under the folder that the session names in
``spark.checkpoint.dir`` (shared by driver and executors).  Where it is unset,
as in tests, a temporary folder of this process is named instead; on a cluster
that is an error, since each machine would write to its own disk.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
ROOT = str(Path(__file__).resolve().parents[2])
_OWN: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and take batches of a bounded size."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:  # whole texts: fewer of them in memory at a time
        spark.conf.set(BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI or path that both Spark and pyarrow.fs open."""
    base = spark.conf.get(CHECKPOINT, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} names no folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="claimloom-"))
        base = f"file://{_OWN[0]}"
    return f"{base.rstrip('/')}/claimloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; the JVM deletes it when it ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs nothing that was written, and readers prune columns.
    """
    spark = df.sparkSession
    path = f"{scratch_path(spark, what)}/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def steady() -> Iterator[None]:
    """In a Python worker: no search for garbage cycles while many small objects live, and freed memory goes back at the end."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def steadily(run: Callable) -> Callable:
    """``run`` of a mapInArrow, held steady."""

    def held(batches):
        with steady():
            yield from run(batches)

    return held


def own_column(name: str) -> Column:
    """A column by its very name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a documents table, null text as the empty text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
