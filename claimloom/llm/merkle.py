"""A Merkle manifest of a documents table: leaves, subtrees by source, root and proofs.

Digests are lowercase hex SHA-256; a node's is that of its children's digests
as text, three children a node, fewer (even one) in the last run of a level.

1.  Leaves are numbered within their source over range partitions that are
    saved; a row a partition and source tells how many come before.
2.  A combiner takes indexed digests in any order.  A parent's arity follows
    from its place and the number of leaves; when a partial parent holds that
    many children, its digest goes to the parent above.  Each task combines
    what it has read; a subtree that ends there is a bundle (its leaves and its
    digest): it has ``LOW`` levels, is a whole source, or stands below a parent
    whose other children are in another task.
3.  The frontier, a row a bundle, is dealt by source and block of ``LOW + STEP``
    levels, combined again, and so on by ``STEP`` more levels until a source has
    one node.  Blocks are no larger for a larger source.  The subroots are the
    leaves of one more such tree.
4.  Every combined node keeps the link to the top of its block: its siblings,
    level by level.  Links are joined from the root down; a bundle with its
    links gives the proofs of its leaves.

Rows are documents; those that agree in all hashed columns are leaves of their
own with one digest.  A null doc_id comes first in its source, equal doc_ids
follow the order of their digests.  A null source is a source of its own and
comes first.  A row without a doc_id is never tampered with.  Texts are hashed
whole.  One document: its leaf is subroot and root, and the proof is the hash
of nothing.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, partitions, steadily, table

FAN, LOW, STEP = 3, 6, 4
#: Rows a partition and source that are broadcast at most; beyond, the same join shuffles.
BROADCAST_ROWS = 100_000
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"
_NODES = "src string, n long, level int, idx long, digest string"


def digest(*columns: Column) -> Column:
    """H of values: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def source_key(source: Column) -> Column:
    """A text that is never null and orders as sources do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def leaves(docs: DataFrame, changed: Column | None = None, when: Column | None = None) -> DataFrame:
    """(src, doc_id, digest, other): a row a document; ``other`` is the leaf with the text ``changed``, null where ``when`` is not true."""
    own = [F.col(c) for c in HASHED]
    other = F.lit(None).cast("string") if changed is None else F.when(when, digest(*own[:-1], changed))
    return docs.select(source_key(F.col("source")).alias("src"), F.col("doc_id").cast("long").alias("doc_id"), digest(*own).alias("digest"), other.alias("other"))


def indexed(rows: DataFrame, group: str, order: list[str], what: str) -> DataFrame:
    """``rows`` with ``idx``, their number from 0 within ``group`` in ``order``, and ``n``, the group's number of rows."""
    spark = rows.sparkSession
    sorted_ = rows.repartitionByRange(partitions(spark), group, *order).sortWithinPartitions(group, *order)
    dealt = materialise(sorted_.withColumn("_i", F.monotonically_increasing_id()), what)  # bounds of ranges come from a sample: saved
    dealt = dealt.withColumn("_p", F.shiftright("_i", 33)).withColumn("_r", F.col("_i").bitwiseAND((1 << 33) - 1))
    counts = dealt.groupBy(group, "_p").agg(F.count("*").alias("_c"), F.min("_r").alias("_least"))
    within = Window.partitionBy(group).orderBy("_p")  # a row a partition
    counts = counts.select(
        group, "_p", "_least",
        F.coalesce(F.sum("_c").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
    )
    counts = materialise(counts, f"{what}-counts")
    held = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    return dealt.join(held, [group, "_p"]).withColumn("idx", F.col("_before") + F.col("_r") - F.col("_least")).drop("_i", "_p", "_r", "_least", "_before")


def height(n: int) -> int:
    """Levels above the leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree of ``n`` leaves."""
    return -(-n // FAN**level)


def join(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


class Combiner:
    """Partial parents of one tree of ``n`` leaves, up to level ``top``.

    ``add`` returns the nodes of the top level (or the root) that it completes.
    ``below`` holds the digests of all nodes that are not yet part of such one.
    """

    def __init__(self, n: int, top: int):
        self.n, self.top = n, min(top, height(n))
        self.partial: dict[tuple[int, int], dict[int, str]] = {}

    def add(self, level: int, idx: int, digest: str) -> tuple[int, int, str] | None:
        while level < self.top:
            parent = idx // FAN
            children = self.partial.setdefault((level, parent), {})
            children[idx] = digest
            if len(children) < min(FAN, width(self.n, level) - FAN * parent):
                return None
            level, idx, digest = level + 1, parent, join([children[k] for k in sorted(children)])
            # the completed parent's children are looked up again for paths and so stay until the top is done
        return level, idx, digest

    def frontier(self) -> Iterator[tuple[int, int, str]]:
        """Children of the parents that are still partial."""
        for (level, parent), children in self.partial.items():
            if len(children) < min(FAN, width(self.n, level) - FAN * parent):
                yield from ((level, k, d) for k, d in children.items())

    def forget(self, level: int, idx: int) -> None:
        """Drops what stands below a node that is emitted."""
        for below in range(level):
            first, span = idx * FAN ** (level - below - 1), FAN ** (level - below - 1)
            for parent in range(first, min(first + span, width(self.n, below + 1))):
                self.partial.pop((below, parent), None)

    def path(self, level: int, idx: int, to: int) -> list[tuple[str, str]]:
        """The siblings left and right of a node and of its ancestors below level ``to``."""
        out = []
        while level < to:
            children = self.partial[level, idx // FAN]
            out.append(("".join(d for k, d in sorted(children.items()) if k < idx), "".join(d for k, d in sorted(children.items()) if k > idx)))
            level, idx = level + 1, idx // FAN
        return out


_BUNDLES = pa.schema([("src", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()),
                      ("doc_ids", pa.list_(pa.int64())), ("leaves", pa.list_(pa.string())), ("others", pa.list_(pa.string()))])


def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: leaves (src, n, idx, doc_id, digest, other) in any order to bundles."""
    open_: dict[str, tuple[Combiner, dict[int, tuple]]] = {}
    done: list[tuple] = []

    def emit(src: str, level: int, idx: int, top: str) -> None:
        combiner, held = open_[src]
        under = [held.pop(k) for k in range(idx * FAN**level, min((idx + 1) * FAN**level, combiner.n))]
        done.append((src, combiner.n, level, idx, top, *map(list, zip(*under, strict=True))))

    def flush() -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _BUNDLES, strict=True)], schema=_BUNDLES)
            done.clear()

    for batch in batches:
        for src, n, idx, doc_id, leaf, other in zip(*(batch.column(c).to_pylist() for c in ("src", "n", "idx", "doc_id", "digest", "other")), strict=True):
            combiner, held = open_.setdefault(src, (Combiner(n, LOW), {})) if src not in open_ else open_[src]
            held[idx] = (doc_id, leaf, other)
            if top := combiner.add(0, idx, leaf):
                emit(src, *top)
                combiner.forget(*top[:2])
                if not held:
                    del open_[src]
        if len(done) * FAN**LOW >= 1 << 16:
            yield from flush()
    for src, (combiner, _) in open_.items():
        for level, idx, top in list(combiner.frontier()):
            emit(src, level, idx, top)
    yield from flush()


def block(top: int):
    """applyInArrow: the nodes of a block to links: each node's path to the block's top, and that top."""
    out = pa.schema([("src", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("path", pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))),
                     ("top_level", pa.int32()), ("top_idx", pa.int64()), ("digest", pa.string())])

    def run(nodes: pa.Table) -> pa.Table:
        rows = nodes.select(["src", "n", "level", "idx", "digest"]).to_pylist()
        combiner, end = Combiner(rows[0]["n"], top), None
        for r in rows:
            end = combiner.add(r["level"], r["idx"], r["digest"]) or end
        level, idx, root = end
        links = [{k: r[k] for k in ("src", "n", "level", "idx")} | {"path": [{"l": a, "r": b} for a, b in combiner.path(r["level"], r["idx"], level)], "top_level": level, "top_idx": idx, "digest": root} for r in rows]
        return pa.Table.from_pylist(links, out)

    return run


def linked(frontier: DataFrame, what: str) -> DataFrame:
    """(src, level, idx, path, digest): for each node of ``frontier`` (src, n, level, idx, digest) its path to its tree's root, and the root's digest."""
    most = height(frontier.agg(F.max("n")).first()[0] or 0)
    schema = f"src string, n long, level int, idx long, path {PATH}, top_level int, top_idx long, digest string"
    rounds, top = [], LOW
    while True:
        top += STEP
        dealt = frontier.withColumn("block", F.expr(f"cast(floor(idx / power({FAN}, {top} - level)) as bigint)"))
        links = materialise(dealt.groupBy("src", "block").applyInArrow(block(top), schema), f"{what}-links{top}")
        rounds.append(links)
        if top >= most:
            break
        frontier = links.groupBy("src", "n", "top_level", "top_idx").agg(F.min("digest").alias("digest")).withColumnRenamed("top_level", "level").withColumnRenamed("top_idx", "idx")
    found = rounds[-1].select("src", "level", "idx", "path", "digest")
    for links in reversed(rounds[:-1]):
        above = found.select("src", F.col("level").alias("top_level"), F.col("idx").alias("top_idx"), F.col("path").alias("_above"), F.col("digest").alias("_root"))
        found = links.join(above, ["src", "top_level", "top_idx"]).select("src", "level", "idx", F.concat("path", "_above").alias("path"), F.col("_root").alias("digest"))
    return found


def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: bundles with their links to the proofs of their leaves."""
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            combiner, base = Combiner(r["n"], r["level"]), r["idx"] * FAN ** r["level"]
            for k, leaf in enumerate(r["leaves"]):
                combiner.add(0, base + k, leaf)
            above = [(x["l"], x["r"]) for x in r["path"]]
            for k, (doc_id, leaf, other) in enumerate(zip(r["doc_ids"], r["leaves"], r["others"], strict=True)):
                path = combiner.path(0, base + k, r["level"]) + above
                folded = leaf if other is None else other
                for left, right in path:
                    folded = join([left, folded, right])
                out.append((doc_id, leaf, r["subroot"], r["root"], join([x for pair in path for x in pair]), folded, folded == r["root"]))
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)


def manifest(docs: DataFrame, changed: Column | None = None, when: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each document.

    ``changed`` is a text that stands in for the one that is claimed where
    ``when`` holds: ``folded_root`` is what the original siblings make of it,
    ``verified`` whether that is the root.
    """
    rows = materialise(leaves(docs, changed, when), "merkle-leaves")
    numbered = indexed(rows, "src", ["doc_id", "digest"], "merkle-sorted")
    columns = ["src", "n", "idx", "doc_id", "digest", "other"]
    bundles = numbered.select(*columns).mapInArrow(steadily(bundle), f"{_NODES}, doc_ids array<long>, leaves array<string>, others array<string>")
    bundles = materialise(bundles, "merkle-bundles")
    paths = linked(bundles.select("src", "n", "level", "idx", "digest"), "merkle")
    subroots = paths.groupBy("src").agg(F.min("digest").alias("subroot"))
    upper = indexed(subroots.select(F.lit("").alias("all"), "src", F.col("subroot").alias("digest")), "all", ["src"], "merkle-sources")
    upper = materialise(upper, "merkle-subroots")
    roots = linked(upper.select(F.lit("").alias("src"), "n", F.lit(0).alias("level"), "idx", "digest"), "merkle-top")
    above = upper.select("src", F.col("digest").alias("subroot"), "idx").join(roots.select("idx", F.col("path").alias("_above"), F.col("digest").alias("root")), "idx").drop("idx")
    links = paths.join(above, "src").select("src", "level", "idx", F.concat("path", "_above").alias("path"), "subroot", "root")
    whole = bundles.join(links, ["src", "level", "idx"]).select("n", "level", "idx", "doc_ids", "leaves", "others", "path", "subroot", "root")
    return whole.mapInArrow(steadily(prove), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, and whether a text without its line feeds passes for the original."""
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, F.replace(F.col("text"), F.lit("\n"), F.lit("")), F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text."""
    bits = f"flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split({text}, '')])"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)))"


def _value(c: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _levels(start: str, name: str) -> str:
    """The levels of trees (g, i, n, h) from their leaves."""
    return f"""{name} AS (
  SELECT 0 AS level, g, i, n, h FROM {start}
  UNION ALL
  SELECT level + 1, g, i // {FAN}, CAST(ceil(n / {FAN}) AS BIGINT), sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY level, g, i // {FAN}, n
)"""


def _siblings(nodes: str, name: str) -> str:
    """What stands left and right of each node in its run."""
    return f"""{name} AS (
  SELECT level, g, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY level, g, i // {FAN} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY level, g, i // {FAN} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {nodes} WHERE n > 1
)"""


OP11_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, sha256({" || ".join(map(_value, HASHED))}) AS h,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0
      THEN sha256({" || ".join([*map(_value, HASHED[:-1]), _value("replace(text, chr(10), '')")])}) END AS other
  FROM documents
), leaf AS (
  SELECT *, coalesce('1' || source, '0') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed
), {_levels("leaf", "nodes")}, subroot AS (
  SELECT g AS source_key, h, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), {_levels("subroot", "tops")}, {_siblings("nodes", "beside")}, {_siblings("tops", "above")}, path AS (
  SELECT d.doc_id, d.g, d.i, b.level AS k, b.l, b.r FROM leaf d JOIN beside b ON b.g = d.g AND b.i = d.i // CAST(pow({FAN}, b.level) AS BIGINT)
  UNION ALL
  SELECT d.doc_id, d.g, d.i, 100 + a.level, a.l, a.r FROM leaf d JOIN subroot s ON s.source_key = d.g JOIN above a ON a.i = s.i // CAST(pow({FAN}, a.level) AS BIGINT)
), steps AS (
  SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY k) AS step FROM path
), proof AS (
  SELECT g, i, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY g, i
), fold AS (
  SELECT g, i, 0 AS step, coalesce(other, h) AS h FROM leaf
  UNION ALL
  SELECT f.g, f.i, f.step + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN steps s ON s.g = f.g AND s.i = f.i AND s.step = f.step + 1
), folded AS (
  SELECT g, i, arg_max(h, step) AS h FROM fold GROUP BY g, i
)
SELECT d.doc_id, d.h AS leaf, s.h AS subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaf d JOIN subroot s ON s.source_key = d.g JOIN folded f ON f.g = d.g AND f.i = d.i CROSS JOIN (SELECT h FROM tops WHERE n = 1) t LEFT JOIN proof p ON p.g = d.g AND p.i = d.i
"""
