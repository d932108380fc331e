"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector goes through three rounds of random signs and a fast Hadamard
transform; the signed axis nearest to the result is its bucket in a table.
Every vector is indexed in every table; a query also visits the buckets of its
next nearest axes.  Buckets are compared in blocks, a query against all of a
block, and only the best of a block go on; crowded buckets are cut into blocks
by hash, and a query visits all of them.  Equal vectors are one row with their
smallest ids, as many as a result can hold.

Scores are cosines of the original vectors in double precision.  Vectors that
are null, zero or hold a null or non-finite component, and rows without a
vec_id, take no part.  Vectors are near vectors of their own length only.  A
query that its probes leave with too few neighbours is held against all blocks
of one table, where every vector stands once.  Rows that repeat a vec_id
and its vector count once.  No candidates: no rows.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, partitions, prepare, table

TABLES, PROBES, NEAREST, QUERY_EVERY = 6, 14, 5, 50
BLOCK = 4096
SEED = 11


def signs(table_no: int, width: int) -> np.ndarray:
    return np.random.default_rng([SEED, table_no]).integers(0, 2, (3, width)).astype(np.float32) * 2 - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotated(x: np.ndarray, table_no: int) -> np.ndarray:
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, d - x.shape[1]))).astype(np.float32)
    for s in signs(table_no, d):
        x = hadamard(x * s) / np.float32(np.sqrt(d))
    return x


def axes(x: np.ndarray, table_no: int, most: int) -> np.ndarray:
    """Buckets (rows, most) of the nearest signed axes, nearest first."""
    r = rotated(x, table_no)
    both = np.concatenate([r, -r], axis=1)
    most = min(most, both.shape[1])
    top = np.argpartition(-both, most - 1, axis=1)[:, :most]
    order = np.argsort(-np.take_along_axis(both, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1) + table_no * both.shape[1]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    e = F.col("embedding")
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    e = e.cast(f"array<{kind}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    infinite = F.array(*[F.lit(x).cast(kind) for x in (float("inf"), float("-inf"), float("nan"))])
    ok = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.array_contains(infinite, v)) & F.exists(e, lambda v: v != 0)
    return rows.filter(F.col("vec_id").isNotNull()).filter(F.coalesce(ok, F.lit(False)))


def hashed(rows: DataFrame, width: int, probes: int) -> DataFrame:
    """``rows`` (id.., embedding last) once for each bucket, as ``bucket``."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                if not len(batch):
                    continue
                x = matrix(batch.column(batch.num_columns - 1), width)
                found = np.concatenate([axes(x, t, probes) for t in range(TABLES)], axis=1)
                take = pa.array(np.repeat(np.arange(len(batch)), found.shape[1]))
                columns = [c.take(take) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().astype(np.int32)), *columns], ["bucket", *batch.schema.names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"bucket int, {fields}")


def nearest(vectors: DataFrame, query: F.Column, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each row that ``query`` selects."""
    spark = vectors.sparkSession
    prepare(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = clean(vectors)
    every = spark.createDataFrame([], schema)
    for (width,) in sorted(rows.select(F.size("embedding")).distinct().collect()):  # a table of embeddings has few lengths
        every = every.unionByName(_nearest(rows.filter(F.size("embedding") == width), query, k, width))
    return every


def _nearest(rows: DataFrame, query: F.Column, k: int, width: int) -> DataFrame:
    """``nearest`` among vectors of one length."""
    spark = rows.sparkSession
    rows = rows.distinct()
    # a result of one vector holds at most k others and the query itself
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    base = materialise(numbered.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "embedding"), "ann-vectors")
    asked = rows.filter(query)
    queries = materialise(asked.groupBy("embedding").agg(F.min("vec_id").alias("q")).select("q", "embedding"), "ann-queries")
    indexed = hashed(base, width, 1)
    crowds = {b: c for b, c in indexed.groupBy("bucket").count().collect()}  # at most TABLES * 2 * width (rounded up)
    blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(v).cast("int") for b, c in crowds.items() for v in (b, -(-c // BLOCK))]), F.col("bucket")), F.lit(0)) if crowds else F.lit(0)
    indexed = indexed.withColumn("block", F.pmod(F.xxhash64("ids"), blocks).cast("int"))
    probing = hashed(queries, width, PROBES).withColumn("n", blocks).filter("n > 0")
    probing = probing.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            x = matrix(left["embedding"], width).astype(np.float64)
            y = matrix(right["embedding"], width).astype(np.float64)
            nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            q = right["q"].to_numpy()
            ids = left["ids"].to_pylist()
            for at in range(0, len(y), 256):
                s = (y[at : at + 256] @ x.T) / nx
                some = min(len(x), k + 1)
                # whatever rounding may have put behind the last of them is looked at exactly, ties included
                last = -np.partition(-s, some - 1, axis=1)[:, some - 1] - ny[at : at + 256] * (width + 8) * 2.0**-50
                for i, row in enumerate((np.flatnonzero(r >= least) for r, least in zip(s, last, strict=True)), at):
                    exact = (x[row] * y[i]).sum(axis=1) / (nx[row] * ny[i])
                    every = sorted((-e, v) for e, j in zip(exact.tolist(), row.tolist(), strict=True) for v in ids[j])[: k + 1]
                    out += [(int(q[i]), v, -e) for e, v in every]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("q", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    n = partitions(spark)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    def met(asking: DataFrame, held: DataFrame) -> DataFrame:
        """(q, found): the best of what the queries meet in the blocks."""
        pairs = (
            held.repartition(n, "bucket", "block").groupBy("bucket", "block")
            .cogroup(asking.repartition(n, "bucket", "block").groupBy("bucket", "block"))
            .applyInArrow(compare, "q long, vec_id long, score double")
        )
        merged = pairs.groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
        return merged.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))

    lists = materialise(met(probing, indexed), "ann-lists")
    enough = min(k + 1, rows.select("vec_id").limit(k + 1).count())
    short = queries.join(lists.filter(F.size("found") >= enough), "q", "left_anti")
    if not short.isEmpty():
        first = sorted((b, -(-c // BLOCK)) for b, c in crowds.items() if b < 2 * (1 << max(1, (width - 1).bit_length())))  # the first table's
        blocks_of = F.array(*[F.struct(F.lit(b).cast("int").alias("bucket"), F.lit(x).cast("int").alias("block")) for b, c in first for x in range(c)])
        asking = short.withColumn("at", F.explode(blocks_of)).select("at.bucket", "q", "embedding", "at.block")
        lists = lists.join(short.select("q"), "q", "left_anti").unionByName(met(asking, indexed.join(F.broadcast(asking.select("bucket").distinct()), "bucket", "left_semi")))
    same = asked.join(queries, "embedding").select(F.col("vec_id").alias("query_id"), "q")
    others = same.join(lists, "q").select("query_id", F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("found"))
    flat = others.select("query_id", F.posexplode("found").alias("p", "x"))
    return flat.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every row whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
