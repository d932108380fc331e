"""Exact nearest neighbours by blocks around pivots, and the answer of their majority.

Vectors go to the block of their nearest pivot, a block keeps the least and the
greatest distance of its vectors from it.  By the triangle inequality no vector
of a block is nearer to a query than ``d(q, pivot) - greatest`` or ``least -
d(q, pivot)``.  A query first meets the blocks of its nearest pivots that hold
``k`` vectors together; their k-th distance is a bound, and only blocks that may
hold something nearer are met then.  Blocks of many vectors are split, and each
meeting gives its own ``k`` best alone, so what is shuffled and merged is small.

The result is exact whatever the pivots, which are a bounded number of vectors
by hash.  Equal distances (to nine digits of the square) go to the smaller id.
A query is no neighbour of itself.  Vectors that are null, of another length
than most pivots have, or hold nulls or numbers that are not finite take no
part; fewer than ``k`` others are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.storage import written

PIVOTS, BLOCK = 32, 20_000


def _clean(vectors: DataFrame, width: int | None = None) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.withColumn("embedding", F.col("embedding").cast("array<double>")).filter(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
    return rows if width is None else rows.filter(F.size("embedding") == width)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(-1, width)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and of y, by differences."""
    return np.array([((y - row) ** 2).sum(axis=1) for row in x]).reshape(len(x), len(y))


def nearest(base: DataFrame, query: Column, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, square, blocks_met): the ``k`` nearest rows of ``base`` (vec_id, embedding) to each row that ``query`` selects."""
    spark = base.sparkSession
    schema = "query_id long, rank int, vec_id long, square double, blocks_met int"
    chosen = _clean(base).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # a bounded number
    if not chosen:
        return spark.createDataFrame([], schema)
    sizes = [len(r.embedding) for r in chosen]
    width = max(sorted(set(sizes)), key=sizes.count)
    centres = np.unique(np.array([r.embedding for r in chosen if len(r.embedding) == width]), axis=0)
    rows = _clean(base.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", query.alias("asked")), width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.sqrt(_squares(_matrix(batch.column("embedding"), width), centres))
            own = far.argmin(axis=1) if len(far) else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], [*batch.schema.names, "block", "far"])

    held = written(rows.mapInArrow(assign, "vec_id long, embedding array<double>, asked boolean, block int, far double"))
    count, low, high = np.zeros(len(centres), dtype=int), np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    for r in held.groupBy("block").agg(F.count("*").alias("n"), F.min("far").alias("a"), F.max("far").alias("b")).collect():  # a row a pivot
        count[r.block], low[r.block], high[r.block] = r.n, r.a, r.b
    splits = -(-count // BLOCK)
    split_of = F.element_at(F.array(*[F.lit(int(max(1, s))) for s in splits]), F.col("block") + 1)
    dealt = held.select("vec_id", "embedding", "block", F.pmod(F.xxhash64("vec_id"), split_of).cast("int").alias("part"))

    def meetings(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, int, int]] = []
                far = np.sqrt(_squares(_matrix(batch.column("embedding"), width), centres))
                for i, d in enumerate(far):
                    order = [b for b in np.argsort(d, kind="stable") if count[b]]
                    cut = int(np.searchsorted(np.cumsum(count[order]), k + 1)) + 1  # the query itself may be among them
                    if first:
                        some = order[:cut]
                    else:
                        limit = batch.column("limit")[i].as_py()
                        reach = np.inf if limit is None else np.sqrt(limit)
                        slack = 1e-6 * (1 + d)  # squares are compared to nine digits
                        some = [b for b in order[cut:] if max(d[b] - high[b], low[b] - d[b]) - slack[b] <= reach]
                    out += [(i, int(b), p) for b in some for p in range(splits[b])]
                at = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("embedding").take(at), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], ["q", "embedding", "block", "part"])

        return run

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            x, ids = _matrix(left["embedding"], width), left["vec_id"].to_numpy()
            for q, y in zip(right["q"].to_pylist(), _matrix(right["embedding"], width), strict=True):
                square = np.round(((x - y) ** 2).sum(axis=1), 9)
                others = np.flatnonzero(ids != q)
                best = others[np.lexsort((ids[others], square[others]))[:k]]
                out += [(q, int(ids[j]), float(square[j])) for j in best]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("q", "vec_id", "square"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    asked = held.filter("asked").select("vec_id", "embedding")

    def met(asking: DataFrame) -> DataFrame:
        return dealt.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(compare, "q long, vec_id long, square double")

    place = Window.partitionBy("q").orderBy("square", "vec_id")
    asking_schema = "q long, embedding array<double>, block int, part int"
    first = written(asked.mapInArrow(meetings(True), asking_schema))
    found = written(met(first).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k))
    limits = found.filter(F.col("rank") == k).select(F.col("q").alias("vec_id"), F.col("square").alias("limit"))
    second = written(asked.join(limits, "vec_id", "left").mapInArrow(meetings(False), asking_schema))
    every = found.drop("rank").unionByName(met(second)).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    blocks = first.select("q", "block").unionByName(second.select("q", "block")).groupBy("q").agg(F.count_distinct("block").cast("int").alias("blocks_met"))
    return every.join(blocks, "q").select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "square", "blocks_met")


def voted(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """MDL-05: (query_id, predicted): the label most of the neighbours have, the smallest of equal ones; neighbours without one don't vote."""
    counted = neighbours.join(labels.filter("label IS NOT NULL").select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return counted.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("predicted"))
