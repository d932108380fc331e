"""The prefix trie of rebuilt conversations, family first.

Conversation c opens with the first turns of its family's base, conversation
c - c % 100: h of them, h = crc32(decimal c) % 6, and goes on with its own
turns after its first h.  A node is a distinct sequence of first turns.

1.  Turns become 128-bit digests in the JVM; texts go no further.  The base's
    turns and the others' are cogrouped by base id; each family (a hundred ids
    or so) rebuilds its conversations and builds their trie.  A node is named
    by a digest of its parent's name and its turn.
2.  Families' nodes alone are shuffled and added up by name: members, smallest
    member, and the sum over members of what is left of them from there.
3.  A node's smallest member belongs to one family, its owner.  Members that
    start with a node start with its parent, so what an owner owns is closed
    downwards: distinct nodes below a node (leaves, children, code points) are
    summed by families over what they own, and these sums are added up by name.
    No round a level, whatever the depth.
4.  Ids of members that end at a node come in ranges of ids, a text each, and are
    hashed as a stream; a task never holds those of a node together.

Turns of one conversation with the same number are ordered by their digests; a
null number comes first.  A null role or text is empty.  Repeated rows are
turns of their own.  Rows without a conv_id belong to no conversation.  A
remainder has the sign of its conversation.  A family's digests (no texts) are
held in one task, about 200 bytes a turn; a family has at most 199 conversations.
An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, partitions, steadily, table
from claimloom.llm.merkle import crc32_sql

FAMILY, HEADS = 100, 6
#: Families whose ended ids are one text (at most 200,000 ids).
RANGE = 1000
ROOT = bytes(16)
_FAMILY_NODES = pa.schema([("family", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("length", pa.int64()), ("conv_id", pa.int64()),
                           ("n", pa.int64()), ("rest", pa.int64()), ("n_ends", pa.int64()), ("ends", pa.string())])
_SUMS = pa.schema([("node", pa.binary()), ("children", pa.int64()), ("leaves", pa.int64()), ("lengths", pa.int64()), ("parent_conv_id", pa.int64())])


def turns(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, turn, a, b, length): 128 bits of role and text, and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    family = F.expr(f"conv_id - conv_id % {FAMILY}")
    a, b = F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "text", "role")
    return rows.filter("conv_id IS NOT NULL").select(family.alias("family"), "conv_id", "turn", a.alias("a"), b.alias("b"), F.length("text").cast("long").alias("length"))


def _by_conversation(rows: pa.Table) -> dict[int, list[tuple[bytes, int]]]:
    """Each conversation's turns in order, as (digest, length)."""
    found: dict[int, list] = {}
    for c, turn, a, b, length in zip(*(rows.column(x).to_pylist() for x in ("conv_id", "turn", "a", "b", "length")), strict=True):
        found.setdefault(c, []).append((turn is not None, turn or 0, a, b, length))
    return {c: [(a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True), length) for *_, a, b, length in sorted(x)] for c, x in found.items()}


def heads(conv_id: int) -> int:
    """Turns that a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def family_trie(base: pa.Table, others: pa.Table) -> pa.Table:
    """Cogrouped: a family's nodes, its conversations rebuilt."""
    own = _by_conversation(base)
    first = next(iter(own.values()), [])
    own |= _by_conversation(others)
    family = (base if base.num_rows else others).column("family")[0].as_py()
    nodes: dict[bytes, list] = {}  # by name: parent, depth, length, smallest member, members, rest, ended
    for c in sorted(own):
        h = heads(c)
        rebuilt = first[:h] + own[c][h:]
        rest, at, path = sum(length for _, length in rebuilt), ROOT, [(ROOT, None, 0)]
        for turn, length in rebuilt:
            parent, at = at, blake2b(at + turn, digest_size=16).digest()
            path.append((at, parent, length))
        for depth, (name, parent, length) in enumerate(path):
            node = nodes.setdefault(name, [parent, depth, length, c, 0, 0, []])
            node[4] += 1
            node[5] += rest
            rest -= length
        node[6].append(c)
    rows = [(family, name, *x[:6], len(x[6]), ",".join(map(str, x[6]))) for name, x in nodes.items()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FAMILY_NODES, strict=True)], schema=_FAMILY_NODES)


def owned_sums(nodes: pa.Table) -> pa.Table:
    """A family's nodes with their smallest member overall: sums over the nodes below that the family owns."""
    rows = sorted(nodes.to_pylist(), key=lambda r: -r["depth"])
    least = {r["node"]: r["least"] for r in rows}
    leaves: dict[bytes, int] = dict.fromkeys(least, 0)
    lengths, children = dict(leaves), dict(leaves)
    for r in rows:
        name, parent, owned = r["node"], r["parent"], r["least"] == r["conv_id"]
        if owned:
            leaves[name] += r["is_leaf"]
            lengths[name] += r["length"]
        if parent is not None:
            leaves[parent] += leaves[name]
            lengths[parent] += lengths[name]
            children[parent] += owned
    out = [(r["node"], children[r["node"]], leaves[r["node"]], lengths[r["node"]], least.get(r["parent"]) if r["least"] == r["conv_id"] else None) for r in rows]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SUMS, strict=True)], schema=_SUMS)


def hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (node, ends), a node's rows following each other in the order of ids, to the hash of all joined by commas."""
    at, state = None, sha256()
    names = ["node", "ends_sha256"]

    def row(node, state):
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(state, pa.string())], names)

    for batch in batches:
        done, hashes = [], []
        for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node == at:
                state.update(b"," + ends.encode())
                continue
            if at is not None:
                done.append(at)
                hashes.append(state.hexdigest())
            at, state = node, sha256(ends.encode())
        yield row(done, hashes)
    if at is not None:
        yield row([at], [state.hexdigest()])


def trie(conversations: DataFrame) -> DataFrame:
    """A row a node: node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows = turns(conversations)
    base, others = rows.filter("conv_id = family").groupBy("family"), rows.filter("conv_id <> family").groupBy("family")
    schema = "family long, node binary, parent binary, depth long, length long, conv_id long, n long, rest long, n_ends long, ends string"
    families = materialise(base.cogroup(others).applyInArrow(family_trie, schema), "trie-families")

    merged = families.groupBy("node").agg(
        F.min("conv_id").alias("least"), F.min("depth").alias("depth"), F.sum("n").alias("n_convs"), F.sum("rest").alias("rest"), (F.sum("n_ends") == F.sum("n")).alias("is_leaf")
    )
    merged = materialise(merged, "trie-nodes")
    owned = families.select("family", "node", "parent", "depth", "length", "conv_id").join(merged.select("node", "least", "is_leaf"), "node")
    sums = owned.groupBy("family").applyInArrow(owned_sums, "node binary, children long, leaves long, lengths long, parent_conv_id long")
    sums = sums.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "lengths")], F.max("parent_conv_id").alias("parent_conv_id"))

    ended = families.filter("n_ends > 0").groupBy("node", F.expr(f"floor(family / {FAMILY * RANGE})").alias("range"))
    ended = ended.agg(F.expr("array_join(transform(array_sort(collect_list(struct(family, ends))), x -> x.ends), ',')").alias("ends"))
    ended = ended.repartition(partitions(spark), "node").sortWithinPartitions("node", "range").select("node", "ends").mapInArrow(steadily(hash_ends), "node binary, ends_sha256 string")
    found = merged.join(sums, "node").join(ended, "node", "left")
    return found.select(
        "node", F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("rest") - F.col("lengths")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations")).drop("node")


OP13_SQL = f"""
WITH turned AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM turned)
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, t.k, t.role, t.text FROM ids i JOIN turned t ON t.conv_id = i.base AND t.k <= i.h
  UNION ALL
  SELECT i.conv_id, 1, t.k, t.role, t.text FROM ids i JOIN turned t ON t.conv_id = i.conv_id AND t.k > i.h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth, length(text) AS len, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS x FROM rebuilt
), paths AS (
  SELECT conv_id, depth, len, sha256(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(len) AS len, count(*) AS n FROM paths GROUP BY node
), ends AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id) GROUP BY node
), up AS (
  SELECT v.node, v.n, v.len, v.depth, a.node AS above, a.depth AS above_depth FROM nodes v JOIN paths a ON a.conv_id = v.conv_id AND a.depth <= v.depth
), kids AS (
  SELECT above AS node, count(*) FILTER (depth = above_depth + 1) AS n_children FROM up GROUP BY above
), below AS (
  SELECT u.above AS node, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((u.n - 1) * u.len) AS saved FROM up u JOIN kids k ON k.node = u.node GROUP BY u.above
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, k.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes v JOIN kids k ON k.node = v.node JOIN below b ON b.node = v.node LEFT JOIN ends e ON e.node = v.node
LEFT JOIN up u ON u.node = v.node AND u.above_depth = v.depth - 1 LEFT JOIN nodes p ON p.node = u.above
"""
