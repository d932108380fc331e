"""Byte-pair encoding as a streaming transducer of bounded lookahead, and its decoder.

A text is cut at special tokens, then into pieces by the vocabulary's rule;
merges stay within a piece.  A piece's bytes go through a transducer that holds
a window of them.  What the bytes to come can still change is bounded by the
merge list: let two inputs agree up to some byte.  Their segmentations agree up
to a place that only moves left when a merge joins the token x that ends there
with a token that starts there in one of them alone.  That token grew from the
x of the move before, and its merge ranks higher, so the moves follow a chain
of merges of growing rank, each of whose right tokens begins with the left
token of the one before; the bytes of the chain's left tokens add up to the
distance.  The greatest such sum is the lookahead: tokens that end at least
that far before the window's end are stable and emitted, and encoding goes on
behind them, as no merge crosses a token's edge.  The window has as many bytes
as the lookahead and a fixed step, however long the piece.

Pieces that a worker has met are kept, in a cache of bounded size.  Decoding
looks up the bytes of each id and passes them to a state machine that holds an
unfinished character and writes U+FFFD for what is no UTF-8.

A null text is empty and has no ids; texts are encoded whole.  Rows are handled
one by one, so ties and repeats need nothing.  Ids that the vocabulary does not
have, and null ones, are left out by the decoder; null ids are the empty text.
An empty table gives no rows.  Other columns are kept, whatever their names.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import steadily, table
from claimloom.llm.subword import _byte_signs, _Cache, vocabulary

#: Letters, numbers and blanks up to U+024F as regular expression classes (fixed values), for texts of such signs alone.
LETTERS, NUMBERS, BLANKS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
#: The vocabulary's splitting rule (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BEYOND = re.compile("[^\0-ɏ]")
#: Bytes that a window takes in at a time; pieces up to this size are encoded at once.
STEP = 1024
#: Ids that the decoder turns to text at a time.
RUN = 1 << 16
#: Pieces of more characters are not kept.
LONG = 64

_MODELS: dict[str, "Model"] = {}


class Model:
    """The merge list, its lookahead and the bytes of each id."""

    def __init__(self, path: str, keep: int = 500_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        signs = {s: b for b, s in _byte_signs().items()}
        raw = lambda token: bytes(signs[c] for c in token)
        vocab = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        ids = {t: i for i, t in self.bytes_of.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.rule: list[tuple[int, int, int]] = []
        for x, z in merges:
            pair = (vocab[x], vocab[z])
            if pair not in self.rank:
                self.rank[pair] = len(self.rule)
                self.rule.append((*pair, vocab[x + z]))
        none = len(self.rule)  # beyond all ranks
        self.made = [xz for _, _, xz in self.rule]
        self.first = [[self.rank.get((x, z), none) for z in self.single] for x in self.single]  # of two bytes
        self.lookahead = self._lookahead()
        self.pieces = _Cache(keep)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._splitter = (path, None)

    def _lookahead(self) -> int:
        """The most bytes before the end of what was read that bytes to come can change (see above)."""
        begins: dict[int, list[int]] = {}  # a token and the left tokens that it grew from
        best: dict[int, int] = {}  # longest chain that ends in a merge of this left token
        for rank, (x, z, xz) in enumerate(self.rule):
            for part in (x, z):
                begins.setdefault(part, [part])
            if xz in begins and rank:
                raise ValueError(f"merge {rank} makes a token that an earlier one uses or makes")  # ranks would not tell the order
            begins[xz] = [*begins[x], xz]
            chain = len(self.bytes_of[x]) + max(best.get(t, 0) for t in begins[z])
            best[x] = max(best.get(x, 0), chain)
        return max(best.values(), default=0)

    def merged(self, data: bytes) -> list[int]:
        """The ids of a window: merges by rank, the leftmost first."""
        single, first = self.single, self.first
        ids = [single[b] for b in data]
        if len(ids) > 48:
            return self._merged_by_heap(ids)
        ranks = [first[a][b] for a, b in zip(data, data[1:])]  # noqa: B905
        rank, made = self.rank.get, self.made
        none = len(made)
        ranks.append(none)  # behind the last
        while (least := min(ranks)) < none:
            at = ranks.index(least)
            ids[at] = xz = made[least]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], xz), none)
            if at + 1 < len(ids):
                ranks[at] = rank((xz, ids[at + 1]), none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            x, z, xz = self.rule[r]
            right = after[k]
            if ids[k] != x or right >= n or ids[right] != z:
                continue
            ids[k], ids[right], after[k] = xz, -1, after[right]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank.get((xz, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := rank.get((ids[before[k]], xz))) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [i for i in ids if i >= 0]

    def stream(self, chunks: Iterator[bytes]) -> Iterator[list[int]]:
        """The ids of a piece that comes in chunks, as soon as they are stable."""
        window = b""
        for chunk in chunks:
            window += chunk
            while len(window) >= self.lookahead + STEP:
                stable, end = [], 0
                for i in self.merged(window[: self.lookahead + STEP]):
                    if end + len(self.bytes_of[i]) > STEP:
                        break
                    stable.append(i)
                    end += len(self.bytes_of[i])
                window = window[end:]
                yield stable
        yield self.merged(window)

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if not (odd := BEYOND.search(text)):
            return PLAIN.findall(text)
        if any(unicodedata.ucd_3_2_0.category(c) == "Cn" for c in set(text[odd.start() :])):
            return self._split_by_library(text)  # classes of newer signs depend on a library's Unicode version
        return PIECES.findall(text)

    def _split_by_library(self, text: str) -> list[str]:
        path, splitter = self._splitter
        if splitter is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            splitter = Tokenizer.from_file(path).pre_tokenizer
            self._splitter = (path, splitter)
        return [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) <= STEP:  # no longer than one chunk: the window holds it whole
            return array("i", self.merged(data)).tobytes()
        chunks = (data[k : k + STEP] for k in range(0, len(data), STEP))
        return b"".join(array("i", ids).tobytes() for ids in self.stream(chunks))

    def _segment(self, text: str) -> bytes:
        pieces, known = self.split(text), self.pieces
        young = known.young
        found = list(map(young.get, pieces))
        for k in [k for k, x in enumerate(found) if x is None]:
            piece = pieces[k]
            if (x := young.get(piece)) is None:  # met earlier in this text
                if (x := known.old.get(piece)) is None:
                    x = self._piece(piece)
                if len(piece) <= LONG:
                    young[piece] = x
            found[k] = x
        known.age()
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._segment(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._segment(text[at : m.start()]), array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._segment(text[at:])])


class Decoder:
    """Ids to text, a run at a time; the state is the bytes of an unfinished character."""

    def __init__(self, model: Model):
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.bytes_of = model.bytes_of

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.machine.decode(b"".join([self.bytes_of.get(i, b"") for i in ids]), last)


def model(path: str) -> Model:
    """One model per worker process and vocabulary."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _groups(batch: pa.RecordBatch, column: int, per_row) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about 8 MB."""
    at = size = 0
    for k, n in enumerate(per_row(batch.column(column))):
        if k > at and size + n > 1 << 23:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def encode(rows: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with the token ids of ``text`` in a column ``ids``, in the place of the text."""
    path = path or vocabulary("byte_bpe_50k.json")
    k = rows.columns.index(text)
    schema = rows.schema
    own = ", ".join(f"_c{i} {'array<int>' if i == k else f.dataType.simpleString()}" for i, f in enumerate(schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model(path)
        for whole in batches:
            for batch in _groups(whole, k, lambda c: (len(x) if (x := v.as_py()) else 0 for v in c)):
                found = [held.encode(x or "") for x in batch.column(k).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([column if i == k else batch.column(i) for i in range(batch.num_columns)], [f"_c{i}" for i in range(batch.num_columns)])

    given = rows.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rows.columns)])
    return given.mapInArrow(steadily(run), own).select(*[F.col(f"_c{i}").alias(ids if i == k else c) for i, c in enumerate(rows.columns)])


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """``rows`` with the text of a column of token ids added at the end."""
    path = path or vocabulary("byte_bpe_50k.json")
    k, n = rows.columns.index(ids), len(rows.columns)
    own = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model(path)
        for whole in batches:
            for batch in _groups(whole, k, lambda c: (4 * len(v) if v.is_valid else 0 for v in c)):
                texts = []
                for coded in batch.column(k).to_pylist():
                    machine, coded = Decoder(held), coded or []
                    parts = [machine.feed(coded[at : at + RUN]) for at in range(0, len(coded), RUN)]
                    texts.append("".join([*parts, machine.feed([], True)]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [f"_c{i}" for i in range(n + 1)])

    given = rows.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rows.columns)])
    return given.mapInArrow(steadily(run), f"{own}, _c{n} string").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate([*rows.columns, text])])


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document and the text that they decode to, as counts and hashes."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = decode(encode(docs))
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))
