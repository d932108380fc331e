"""Toxicity: a bidirectional gated recurrent network over all overlapping windows.

The network (``bigru``) is fitted on the driver from a bounded sample of
labelled documents outside the held-out fold: ``SAMPLE`` documents, those with
the smallest hash of their doc_id, no text longer than ``LONGEST`` characters
(training only; every text is scored whole).  Inputs are the text's words and
characters alone.  Where a doc_id has several labels the highest counts.
Without labels of both kinds all scores are the share of label 1.

Null or empty text: scored as one window of the empty word.  Repeated rows are
scored each; a null doc_id is in the held-out fold by definition here
(it is never trained on).  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bigru
from claimloom.llm.common import prepare, steadily, table, texts

SAMPLE, LONGEST, FOLDS = 3000, 5_000, 5


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 6) -> bigru.Model | float:
    """The fitted network, or the share of label 1 where there are not two kinds of labels."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = (
        texts(docs)
        .filter(F.length("text") <= LONGEST)
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(sample)
        .select("text", "toxic")
        .collect()
    )
    y = np.array([r.toxic for r in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.0
    return bigru.fit([r.text for r in rows], y, epochs)


def score(docs: DataFrame, model: bigru.Model | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if isinstance(model, float) else bigru.Scorer(model)
        for whole in batches:
            at = 0
            sizes = np.cumsum([len(t) for t in whole.column(1).to_pylist()])
            while at < len(whole):  # about a million characters at a time
                done = int(sizes[at - 1]) if at else 0
                n = max(1, int(np.searchsorted(sizes, done + 1_000_000, "right")) - at)
                batch = whole.slice(at, n)
                at += n
                values = np.full(len(batch), model) if scorer is None else scorer.scores(batch.column(1).to_pylist())
                ids = batch.column(0).to_pylist()
                held = [d is None or zlib.crc32(str(d).encode()) % FOLDS == 0 for d in ids]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0), "held_out": held, "score": pa.array(values, pa.float64()), "predicted": pa.array((values >= 0.5).astype(np.int32))}
                )

    return texts(docs).mapInArrow(steadily(run), "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on labelled rows outside the held-out fold and scores every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
