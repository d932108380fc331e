"""The keyed snapshot against one aggregation over all rows."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from claimloom.streaming import keyed

SCHEMA = "k long, at long, v string, `a.b` int"


def rows_of(rng, n):
    return [(rng.choice([None, *range(12)]), rng.choice([None, *range(50)]), rng.choice("abc"), rng.randint(0, 3)) for _ in range(n)]


def best(rows):
    low = lambda x: (x is not None, x if x is not None else 0)
    out = {}
    for r in rows:
        if r[0] not in out or (low(r[1]), r[2], r[3]) > (low(out[r[0]][1]), *out[r[0]][2:]):
            out[r[0]] = r
    return set(out.values())


def test_late_and_repeated_batches_and_what_is_deleted(spark, tmp_path):
    rng, path, seen = random.Random(1), f"file://{tmp_path}/s", []
    for n in range(5):
        batch = rows_of(rng, 30) if n != 3 else [(7, 99, "z", 1)]
        seen += batch
        df = spark.createDataFrame(batch, SCHEMA)
        keyed.merge(df, n, path, "k", "at", buckets=4, keep=2)
        if n in (2, 4):
            keyed.merge(df, n, path, "k", "at", buckets=4, keep=2)  # tried again
        assert {tuple(r) for r in keyed.snapshot(spark, path, df.schema).collect()} == best(seen)
        if n == 3:  # one key: one bucket is written
            assert len(list(Path(f"{tmp_path}/s/data/v3").glob("_bucket=*"))) == 1
    with pytest.raises(ValueError):
        keyed.merge(df, 3, path, "k", "at", buckets=4)
    lists = sorted(p.name for p in Path(f"{tmp_path}/s/buckets").iterdir())
    assert lists == ["v3", "v4"]
    assert not list(Path(f"{tmp_path}/s/data/v0").glob("_bucket=*")) and not list(Path(f"{tmp_path}/s/data/v1").glob("_bucket=*"))


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    one, two = spark.createDataFrame([(1, 1, "a", 0)], SCHEMA), spark.createDataFrame([(1, 2, "b", 0), (2, 1, "c", 0)], SCHEMA)
    assert keyed.snapshot(spark, path, one.schema).count() == 0
    keyed.merge(one, 0, path, "k", "at", buckets=4)
    two.selectExpr("0 AS _bucket", "*").write.partitionBy("_bucket").parquet(f"{path}/data/v1")  # files without a list
    assert [tuple(r) for r in keyed.snapshot(spark, path, one.schema).collect()] == [(1, 1, "a", 0)]
    keyed.merge(two, 1, path, "k", "at", buckets=4)
    keyed.merge(two.limit(0), 2, path, "k", "at", buckets=4)  # an empty batch
    assert {tuple(r) for r in keyed.snapshot(spark, path, one.schema).collect()} == {(1, 2, "b", 0), (2, 1, "c", 0)}


def test_a_stream_ends_as_a_batch(spark, tmp_path):
    rows = rows_of(random.Random(8), 80)
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(5).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # started again, nothing new comes
        keyed.kept(stream, f"file://{tmp_path}/s", f"file://{tmp_path}/c", "k", "at", buckets=3).awaitTermination()
    assert {tuple(r) for r in keyed.snapshot(spark, f"file://{tmp_path}/s", df.schema).collect()} == best(rows)
