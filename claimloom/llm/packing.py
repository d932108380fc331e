"""Packing by lexical retrieval: a sharded BM25 index fills each seed's window.

Documents are dealt by hash to shards of about ``SHARD_TOKENS`` tokens.  In a
shard an inverted index over token ids (BM25, with document frequencies of the
whole corpus: one number a vocabulary entry) returns the unused neighbours of
the document that opens a window.  They fill it greedily; the last one is cut
where the window ends and opens the next.  So only a shard's last window is
short, and it is cut into sequences of a power of two: nothing is padded.

Null texts are empty and hold the end id alone; rows that repeat a doc_id are
documents of their own; an empty table gives no pieces; extra columns are not
read.  Ties in score go to the smaller (doc_id, checksum of ids).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, prepare, steadily, table, texts
from claimloom.llm.subword import encoder, vocabulary

WINDOW, END_ID = 2048, 1
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75
QUERY_TERMS, NEIGHBOURS = 24, 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, vocab: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, ids) a document; and a row a task with n null, whose ids are document frequencies (u4) by token id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        seen = np.zeros(enc.size, dtype="<u4")
        some = False
        for batch in batches:
            for at in range(0, len(batch), 2000):
                rows = batch.slice(at, 2000)
                if not len(rows):
                    continue
                every = list(enc.many(rows.column(1), end_id))
                n = np.array([len(ids) for ids in every], dtype=np.int64)
                held = np.sort(np.repeat(np.arange(len(every), dtype=np.uint64) << np.uint64(32), n) | np.concatenate(every))
                held = held[np.append(True, held[1:] != held[:-1])]  # each token of a document once
                seen += np.bincount((held & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=enc.size).astype("<u4")
                some = True
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "n": pa.array(n), "ids": pa.array([ids.tobytes() for ids in every], pa.binary())})
        if some:
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None], pa.int64()), "n": pa.array([None], pa.int64()), "ids": pa.array([seen.tobytes()], pa.binary())})

    return texts(docs).mapInArrow(steadily(run), "doc_id long, n long, ids binary")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            counts = np.frombuffer(raw, dtype="<u4")
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"token": some.astype(np.int64), "docs": counts[some].astype(np.int64)})


class Index:
    """BM25 postings of one shard, by token id."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        parts = [np.unique(ids, return_counts=True) for ids in docs]
        self.terms = [p[0] for p in parts]
        tokens = np.concatenate(self.terms)
        tf = np.concatenate([p[1] for p in parts]).astype(np.float32)
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(p[0]) for p in parts])
        length = np.array([len(ids) for ids in docs], dtype=np.float32)[owner]
        weight = idf[tokens] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / np.float32(mean_length)))
        self.weights = np.split(weight, np.cumsum([len(t) for t in self.terms])[:-1])
        order = np.argsort(tokens, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        held = tokens[order]
        self.of = np.searchsorted(held, np.arange(len(idf) + 1))
        self.n = len(docs)

    def neighbours(self, doc: int, used: np.ndarray) -> list[int]:
        """Unused documents by falling score, as many as NEIGHBOURS; none that shares no query term."""
        terms, weights = self.terms[doc], self.weights[doc]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argsort(-weights, kind="stable")[:QUERY_TERMS]]
        spans = [slice(self.of[t], self.of[t + 1]) for t in terms.tolist()]
        scores = np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        scores[used] = 0
        if np.count_nonzero(scores) > NEIGHBOURS:
            top = np.argpartition(-scores, NEIGHBOURS)[:NEIGHBOURS]
        else:
            top = np.flatnonzero(scores)
        return top[np.lexsort((top, -scores[top]))].tolist()


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of all of a shard's documents."""
    index = Index(docs, idf, mean_length)
    used = np.zeros(len(docs), dtype=bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = fill = following = 0
    near: list[int] | None = None
    seed = doc = -1
    start = 0
    while True:
        if doc < 0:
            if near is None and seed >= 0 and fill:
                near = index.neighbours(seed, used)[::-1]
            while near and used[near[-1]]:
                near.pop()
            if near and fill:
                doc = near.pop()
            else:
                while following < len(docs) and used[following]:
                    following += 1
                if following == len(docs):
                    break
                doc = following
            used[doc], start = True, 0
        if not fill:
            seed, near = doc, None
        take = min(len(docs[doc]) - start, window - fill)
        pieces.append((doc, start, take, sequence, fill))
        start, fill = start + take, fill + take
        if start == len(docs[doc]):
            doc = -1
        if fill == window:
            sequence, fill = sequence + 1, 0
    if fill:  # the last window, by the powers of two that make up its length
        last = [p for p in pieces if p[3] == sequence]
        del pieces[len(pieces) - len(last) :]
        room = 1 << (fill.bit_length() - 1)
        fill, at = fill - room, 0
        for d, s, n, _, _ in last:
            while n:
                take = min(n, room - at)
                pieces.append((d, s, take, sequence, at))
                s, n, at = s + take, n - take, at + take
                if at == room and fill:
                    room, at, sequence = 1 << (fill.bit_length() - 1), 0, sequence + 1
                    fill -= room
    return pieces


def pack(docs: DataFrame, vocab: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """All pieces of all documents; see the module's docstring."""
    spark = docs.sparkSession
    prepare(spark)
    rows = materialise(encode(docs, vocab), "packing-ids")
    encoded = rows.filter("n IS NOT NULL")
    n_docs, total = encoded.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return spark.createDataFrame([], PIECES)
    size = encoder(vocab).size
    dtype = encoder(vocab).dtype
    counted = rows.filter("n IS NULL").select("ids").mapInArrow(_frequencies, "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs"))
    df = np.zeros(size, dtype=np.float64)  # bounded by the vocabulary
    for token, seen in counted.collect():
        df[token] = seen
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean_length = total / n_docs
    shards = max(1, math.ceil(total / shard_tokens))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        raw, doc_ids = group["ids"].to_pylist(), group["doc_id"].to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (doc_ids[i] is not None, doc_ids[i] or 0, zlib.crc32(raw[i]), raw[i]))
        tokens = [np.frombuffer(raw[i], dtype=dtype) for i in order]
        base = group["shard"][0].as_py() << 32
        out = [
            (doc_ids[order[d]], s, n, zlib.crc32(tokens[d][s : s + n].astype("<u4")), len(tokens[d]), base + q, at)
            for d, s, n, q, at in pack_shard(tokens, idf, mean_length)
        ]
        columns = zip(*out, strict=True)
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, columns, strict=True)})

    shard = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards))
    return encoded.select("doc_id", "ids", shard.alias("shard")).groupBy("shard").applyInArrow(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary())
