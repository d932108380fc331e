"""Documents as sparse rows of term weights, for learners that read all rows again and again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import features as X
from claimloom.operators.storage import saved, written

#: Rows of a batch that numpy looks at together.
TOGETHER = 512


def weighted(texts: DataFrame, most: int = 20_000, high: int = 1, min_df: int = 1, max_df: float = 1.0) -> tuple[DataFrame, list[str]]:
    """Saved rows (doc_id, js, vs) and the terms: numbers of a document's terms, rising, and their weights, of length 1 together.

    Weights are (1 + ln tf) * idf.  The terms are the ``most`` of the highest
    document frequency that is allowed: they bound what is sent to tasks.  A
    document without any of them (a null text too) has empty arrays; texts
    under one doc_id are one document; those without a doc_id take no part.
    """
    texts = texts.filter("doc_id IS NOT NULL").select("doc_id", X.ngrams(X.terms("text"), 1, high).alias("terms"))
    dealt = texts.groupBy("doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))  # a document's, no row a word
    kind = texts.schema["doc_id"].dataType.simpleString()
    counts = saved(dealt.mapInArrow(_counted, f"doc_id {kind}, terms array<string>, tfs array<int>"))
    told = X.fit_idf(counts.select("doc_id", F.explode("terms").alias("term")), counts.count(), min_df, max_df).orderBy(F.desc("df"), "term").limit(most).toArrow()  # at most ``most``
    terms = told.column("term").combine_chunks()
    shared = texts.sparkSession.sparkContext.broadcast((terms, told.column("idf").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = shared.value
        for batch in batches:
            of, tf = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy()), batch.column("tfs").flatten().to_numpy()
            j = pc.fill_null(pc.index_in(batch.column("terms").flatten(), value_set=terms), -1).to_numpy()
            of, j, tf = of[j >= 0], j[j >= 0], tf[j >= 0]
            order = np.lexsort((j, of))
            of, j, w = of[order], j[order], (1 + np.log(tf[order])) * idf[j[order]]
            norm = np.sqrt(np.bincount(of, w * w, batch.num_rows))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(j.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(w / norm[of]))], ["doc_id", "js", "vs"])

    return written(counts.mapInArrow(run, f"doc_id {kind}, js array<int>, vs array<double>")), terms.to_pylist()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct terms and how often it has them."""
    for every in batches:
        for at in range(0, every.num_rows, TOGETHER):
            few = every.slice(at, TOGETHER)
            lists = few.column("terms")
            found = lists.flatten().dictionary_encode()
            size = max(1, len(found.dictionary))
            of = np.repeat(np.arange(few.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            keys, n = np.unique(of * size + found.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys // size, minlength=few.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.ListArray.from_arrays(ends, found.dictionary.take(pa.array(keys % size))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], ["doc_id", "terms", "tfs"])


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ends, j, v) of every few rows: row r's features stand from ends[r] to ends[r + 1]."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            few = batch.slice(at, TOGETHER)
            js, vs = few.column("js"), few.column("vs")
            ends = js.offsets.to_numpy()
            yield few, ends - ends[0], js.flatten().to_numpy(), vs.flatten().to_numpy()


def products(ends: np.ndarray, j: np.ndarray, v: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows times a matrix (features, columns); empty rows give 0."""
    out = np.zeros((len(ends) - 1, matrix.shape[1]))
    held = np.flatnonzero(np.diff(ends))
    if len(held):
        out[held] = np.add.reduceat(v[:, None] * matrix[j], ends[held], axis=0)
    return out
