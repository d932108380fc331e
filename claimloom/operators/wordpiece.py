"""TOK-09: texts as fixed numbers of word pieces with an attention mask, by a vocabulary table (piece, id)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T

#: What marks a piece within a word, the special pieces and the longest word that is looked at (fixed values).
WITHIN = "##"
PAD, UNKNOWN, BEGIN, END = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
LONGEST_WORD = 100
WORD = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: A vocabulary of up to so many pieces is broadcast, so that no word leaves its text; a larger one is joined.
BROADCAST_PIECES = 300_000
#: Distinct words that a task remembers at once.
REMEMBERED = 100_000


def words(c) -> Column:
    """Lower-case runs of letters and digits, other signs alone."""
    return F.regexp_extract_all(F.lower(T.col(c)), F.lit(WORD), F.lit(0))


def signs(rows: DataFrame, c: str = "text") -> DataFrame:
    """(s): the distinct signs of lower-case texts but white space, told once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {s for text in batch.column(0).to_pylist() if text for s in set(text)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["s"])

    return rows.select(F.lower(T.col(c))).mapInArrow(run, "s string").distinct().filter(F.col("s").rlike(r"[^\s]"))


def parted(vocabulary: DataFrame, every: DataFrame, longest_piece: int) -> DataFrame:
    """(word, ids) of distinct words: from each place the longest piece, from the first place on; null if a word can't be parted.

    All parts of a word that may be pieces are joined with the vocabulary at once and the longest a place is kept by partial
    aggregation; a word's own walk over its at most 100 places is an expression.
    """
    short = every.filter(F.length("word") <= LONGEST_WORD)
    places = short.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    most = F.least(F.lit(longest_piece), F.length("word") - F.col("at") + 1)
    parts = places.select("word", "at", F.explode(F.sequence(F.lit(1), most)).alias("n"))
    part = F.substring("word", F.col("at"), F.col("n"))
    parts = parts.withColumn("piece", F.when(F.col("at") == 1, part).otherwise(F.concat(F.lit(WITHIN), part)))
    best = parts.join(vocabulary.select("piece", "id"), "piece").groupBy("word", "at").agg(F.max(F.struct("n", "id")).alias("best"))
    maps = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "best"))).alias("_m"))  # at most 100 entries

    def step(state, at):
        here = F.try_element_at("_m", at)
        go = (state.at == at) & here.isNotNull()
        return F.struct(F.when(go, at + here.n).otherwise(state.at).alias("at"), F.when(go, F.array_append(state.ids, here.id)).otherwise(state.ids).alias("ids"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"))
    walked = maps.select("word", F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step).alias("w"))
    return walked.select("word", F.when(F.col("w.at") == F.length("word") + 1, F.col("w.ids")).alias("ids"))


class Parted(dict):
    """The ids of words, found as they are asked for: from each place the longest piece; one unknown if a word can't be parted.

    ``reach`` is the length of the longest piece by its first sign, with the mark of those within a word.
    """

    def __init__(self, vocabulary: dict[str, int], reach: dict[str, int], unknown: int):
        self.vocabulary, self.reach, self.unknown = vocabulary, reach, unknown

    def __missing__(self, word: str) -> list[int]:
        at, ids, mark = 0, [], ""
        while at < len(word) <= LONGEST_WORD:
            for end in range(min(len(word), at + self.reach.get(mark + word[at], 0)), at, -1):
                if (found := self.vocabulary.get(mark + word[at:end])) is not None:
                    break
            else:
                break
            ids.append(found)
            at, mark = end, WITHIN
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = ids if at == len(word) else [self.unknown]
        return out


def reaches(pieces) -> dict[str, int]:
    """What ``Parted`` takes as ``reach``."""
    reach: dict[str, int] = {}
    for piece in pieces:
        mark = WITHIN if piece.startswith(WITHIN) else ""
        first = piece[: len(mark) + 1]
        reach[first] = max(reach.get(first, 0), len(piece) - len(mark))
    return reach


def _in_place(rows: DataFrame, plain: DataFrame, unknown: int, c: str, length: int) -> DataFrame:
    """(doc_id, _ids): the pieces of each text by a broadcast vocabulary, without a shuffle."""
    pieces = plain.filter("id IS NOT NULL").groupBy("piece").agg(F.max("id").alias("id"))
    ids = {r.piece: r.id for r in pieces.collect()}  # at most ``BROADCAST_PIECES``
    sent = rows.sparkSession.sparkContext.broadcast((ids, reaches(ids)))
    most = length - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Parted(*sent.value, unknown)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                told = [[i for w in text.split(" ") for i in known[w]][:most] if text else [] for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(told, pa.list_(pa.int32()))], ["doc_id", "_ids"])

    spoken = F.array_join(F.slice(words(c), 1, most), " ")  # no word holds a blank
    return rows.select("doc_id", spoken.alias("_words")).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, _ids array<int>")


def _joined(rows: DataFrame, plain: DataFrame, unknown: int, c: str, length: int) -> DataFrame:
    """(doc_id, _ids): the same by joins, for a vocabulary of any size."""
    size = F.when(F.col("piece").startswith(WITHIN), F.length("piece") - len(WITHIN)).otherwise(F.length("piece"))
    longest = plain.agg(F.max(size)).first()[0] or 1
    at = rows.select("doc_id", F.posexplode(F.slice(words(c), 1, length - 2)).alias("p", "word"))
    found = at.join(parted(plain, at.select("word").distinct(), longest), "word", "left")
    pieces = F.struct("p", F.coalesce("ids", F.array(F.lit(unknown))).alias("ids"))
    texts = found.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(pieces)), lambda x: x.ids)).alias("_ids"))  # at most ``length`` words
    return rows.select("doc_id").join(texts, "doc_id", "left").withColumn("_ids", F.slice(F.coalesce("_ids", F.array().cast("array<int>")), 1, length - 2))


def encoded(rows: DataFrame, vocabulary: DataFrame, c: str = "text", length: int = 384) -> DataFrame:
    """(doc_id, ids, mask): begin, the pieces of a text's words, end, filled to ``length`` ids; the mask is 1 before the filling.

    Pieces beyond ``length`` are cut, so no more words than that are looked at, which is the layout's own limit. A word that
    can't be parted is one unknown piece; a null or empty text is begin and end alone. ``doc_id`` names a row.
    """
    vocabulary = vocabulary.select("piece", F.col("id").cast("int").alias("id"))
    special = {r.piece: r.id for r in vocabulary.filter(F.col("piece").isin(PAD, UNKNOWN, BEGIN, END)).collect()}
    if len(special) < 4:
        raise ValueError(f"the vocabulary lacks special pieces: {sorted({PAD, UNKNOWN, BEGIN, END} - set(special))}")
    plain = vocabulary.filter(~F.col("piece").isin(*special))
    whole = (_in_place if plain.count() <= BROADCAST_PIECES else _joined)(rows, plain, special[UNKNOWN], c, length)
    fill = length - 2 - F.size("_ids")
    ids = F.concat(F.array(F.lit(special[BEGIN])), "_ids", F.array(F.lit(special[END])), F.array_repeat(F.lit(special[PAD]), fill))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("_ids") + 2), F.array_repeat(F.lit(0), fill))
    return whole.select("doc_id", ids.alias("ids"), mask.alias("mask"))
