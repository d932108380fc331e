"""SimHash near-dedup by a segment-popcount embedding and a grid range-join.

A fingerprint is cut into two halves of eight 4-bit segments.  Two that differ
in at most 4 bits differ in at most 2 in one half, so that half's vectors of
segment popcounts are within Manhattan distance 2, a lower bound of the
Hamming distance.  On the integer grid two such vectors have a common cell
within distance 1 of each: every distinct fingerprint goes to its own cell and
the up to 16 next to it, for either half, and only fingerprints that meet in a
cell are compared, bit by bit.  Equal fingerprints are one row throughout.

From a cell only a spanning forest of its links goes on, never all pairs; the
components of the forest are the groups.

Null or empty texts, and texts without words, have fingerprint zero and link
like any other.  Repeated rows are linked by equal fingerprints.  Other texts of
one doc_id are documents of their own: each row has its own text's group, and
the group's name is the smallest doc_id of its rows.  Null doc_ids
are in no group and have a null component.  An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, partitions, prepare, steadily, table, texts
from claimloom.llm.components import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
SEGMENTS, SEGMENT_BITS = 8, 4
BASE = SEGMENT_BITS + 1
#: Cells of up to this many fingerprints are compared side by side, larger ones in tiles.
SIDE = 512


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Bits that are set in over half of the XXH64 hashes of the word shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate([[0], ends[: n - 1]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = batch.slice(at, 1000)
                found = np.array([fingerprint(t, width) for t in rows.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "fp": pa.array(found.view(np.int64))})

    return texts(docs).mapInArrow(steadily(run), "doc_id long, fp long")


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell that each fingerprint goes to, both halves."""
    rows, codes = [], []
    powers = BASE ** np.arange(SEGMENTS, dtype=np.int64)
    for half in range(2):
        shift = (half * 32 + SEGMENT_BITS * np.arange(SEGMENTS)).astype(np.uint64)
        counts = np.bitwise_count((fp[:, None] >> shift[None, :]) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)
        own = counts @ powers + half * BASE**SEGMENTS
        every = np.arange(len(fp))
        rows.append(every), codes.append(own)
        for k in range(SEGMENTS):
            for step in (-1, 1):
                ok = (counts[:, k] + step >= 0) & (counts[:, k] + step < BASE)
                rows.append(every[ok]), codes.append(own[ok] + step * powers[k])
    return np.concatenate(rows), np.concatenate(codes)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges (a, b): its other nodes, and its smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        high = np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


class _Links:
    """Collects links and keeps them at the size of a forest."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.held, self.parts = most, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.held += len(a)
            if self.held > self.most:
                a, b = self.take()
                self.parts, self.held = [(a, b)], len(a)
                self.most = max(self.most, 2 * len(a))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        return forest(a, b)


def compare(cell: np.ndarray, fp: np.ndarray, ids: np.ndarray, links: _Links, bits: int = MAX_BITS) -> None:
    """Links of all fingerprints that share a cell; rows come sorted by cell."""
    if not len(cell):
        return
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(first, len(cell)))
    left = np.repeat(size, size) - (np.arange(len(cell)) - np.repeat(first, size)) - 1  # rows of the cell that follow
    at = np.flatnonzero((left > 0) & (np.repeat(size, size) <= SIDE))
    step = 1
    while len(at):
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= bits
        links.add(ids[at[near]], ids[at[near] + step])
        step += 1
        at = at[left[at] >= step]
    for s, n in zip(first[size > SIDE].tolist(), size[size > SIDE].tolist(), strict=True):
        for i in range(s, s + n, 1024):
            x = fp[i : min(i + 1024, s + n)]
            for j in range(i, s + n, 1024):
                y = fp[j : min(j + 1024, s + n)]
                p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= bits)
                links.add(ids[i + p], ids[j + q])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links that connect all of ``distinct`` (fp, id) that are within MAX_BITS of each other."""
    spark = distinct.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                fp = some.column(0).to_numpy().view(np.uint64)
                rows, codes = cells(fp)
                yield pa.RecordBatch.from_pydict({"cell": codes.astype(np.int32), "fp": some.column(0).take(pa.array(rows)), "id": some.column(1).take(pa.array(rows))})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Links()
        rest: list[tuple] = []
        for batch in batches:
            cell, fp, ids = (batch.column(k).to_numpy() for k in range(3))
            if not len(cell):
                continue
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            rest.append((cell[:cut], fp[:cut], ids[:cut]))
            if cut:
                c, f, i = (np.concatenate(p) for p in zip(*rest, strict=True))
                compare(c, f.view(np.uint64), i, found)
                rest = []
            rest.append((cell[cut:], fp[cut:], ids[cut:]))
        if rest:
            c, f, i = (np.concatenate(p) for p in zip(*rest, strict=True))
            compare(c, f.view(np.uint64), i, found)
        u, v = found.take()
        for at in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_pydict({"u": u[at : at + 100_000], "v": v[at : at + 100_000]})

    dealt = distinct.select("fp", "id").mapInArrow(steadily(deal), "cell int, fp long, id long")
    return dealt.repartition(partitions(spark), "cell").sortWithinPartitions("cell").mapInArrow(steadily(join), "u long, v long")


def groups(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of each document."""
    found = materialise(fingerprints(docs, width), "fingerprints")
    distinct = materialise(found.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    of = components(links(distinct.select("fp", F.col("fp").alias("id"))))  # of fingerprints: a doc_id may have several texts
    rooted = distinct.join(of.hint("shuffle_merge"), distinct["fp"] == of["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = materialise(rooted.join(least.hint("shuffle_merge"), "root").select("fp", "component_id"), "fingerprint-groups")
    joined = found.join(named.hint("shuffle_merge"), "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
