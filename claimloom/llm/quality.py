"""Quality rules: fixed document rules, then boosted trees over document statistics.

The statistics are counts over the whole text, made in one pass of Arrow
batches.  The trees are fitted on the driver from a bounded sample of labelled
documents (``SAMPLE`` of them, those with the smallest hash of their doc_id;
where a doc_id has several labels the worst counts) and held monotone: more
signs, repeated words, repeated lines or capitals never raise a verdict.
Without labels of both kinds the verdict is the base rules' alone.

Null text: no words, so the base rules fail it.  Repeated rows are judged
each.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import trees
from claimloom.llm.common import prepare, steadily, table

SAMPLE = 4000
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Lowest probability of a good document that is kept.
KEEP_FROM = 0.5
#: Name and direction of each feature of the trees.
FEATURES = {
    "symbols_per_word": -1, "repeated_word_share": -1, "repeated_line_share": -1, "capital_share": -1,
    "digit_share": 0, "mark_share": -1, "bar_share": -1, "word_length": 0, "log_words": 0,
    "distinct_share": 0, "words_per_line": 0, "other_share": 0,
}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_IS = {
    name: np.isin(np.arange(256), [ord(c) for c in chars])
    for name, chars in {
        "symbols": "#*$%&|<>", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "small": "abcdefghijklmnopqrstuvwxyz",
        "digits": "0123456789", "marks": "!?", "bars": "|", "signs": "\"'()[]{}/\\_=+^~`@;:",
    }.items()
}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    window = ids[:n]  # exact: each step numbers the distinct windows of one more word
    for k in range(1, width):
        _, window = np.unique(window * len(number) + ids[k : k + n], return_inverse=True)
    twice = np.bincount(window)[window] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The five counts of the base rules, and the trees' features in order."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    of = {k: int(byte[v].sum()) for k, v in _IS.items()}
    chars = len(data) - int(byte[0x80:0xC0].sum()) - int(byte[_BLANK].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats, again = repeated_words(words), len(lines) - len(set(lines))
    n, letters = max(1, len(words)), max(1, chars)
    other = int(byte[0xC0:].sum())
    features = [
        of["symbols"] / n, repeats / n, again / max(1, len(lines)), of["capitals"] / max(1, of["capitals"] + of["small"]),
        of["digits"] / letters, of["marks"] / n, of["bars"] / n, chars / n, float(np.log1p(len(words))),
        len(set(words)) / n, len(words) / max(1, len(lines)), (other + of["signs"]) / letters,
    ]
    return (len(words), chars, of["symbols"], again, repeats), features


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> trees.Forest | None:
    """Fits the trees on at most ``sample`` labelled documents."""
    prepare(docs.sparkSession)
    chosen = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t)[1] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"quality": batch.column(1), "x": pa.array(x, pa.list_(pa.float64()))})

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
        .select("text", "quality")
        .mapInArrow(steadily(run), "quality int, x array<double>")
        .orderBy(F.xxhash64(F.col("x"), "quality"))
        .limit(sample)
        .collect()
    )
    y = np.array([r.quality for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    return trees.fit(np.array([r.x for r in rows]), y, list(FEATURES.values()))


def judge(docs: DataFrame, forest: trees.Forest | None) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept`` of each document.

    ``docs`` must have doc_id and text; of the others only those without a
    clash with the new names are passed on.
    """
    prepare(docs.sparkSession)
    new = [c.split()[0] for c in COUNTS.split(", ")] + ["kept"]
    docs = docs.select([c for c in docs.columns if c not in new])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.slice(start, 1000)
                both = [statistics(t) for t in batch.column(at).to_pylist()]
                if not both:
                    continue
                counts = np.array([b[0] for b in both], dtype=np.int64)
                failed = np.array([base_fails(c[0], c[4]) for c in counts.tolist()])
                good = np.ones(len(both), dtype=bool) if forest is None else forest.probability(np.array([b[1] for b in both])) >= KEEP_FROM
                arrays = [*batch.columns, *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(good & ~failed)]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *new])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(steadily(run), f"{fields}, {COUNTS}, kept boolean")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and final verdict of each document."""
    docs = table(spark, sf_dir, "documents")
    forest = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), forest).drop("text")
