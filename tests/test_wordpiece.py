"""Word pieces against the tokenizers library's greedy model and a plain walk."""

from __future__ import annotations

import random
import re

import pytest
from claimloom.operators import wordpiece as P
from tokenizers.models import WordPiece
from tokenizers import Tokenizer

SPECIAL = [P.PAD, P.UNKNOWN, P.BEGIN, P.END]
PIECES = [*SPECIAL, "a", "b", "##a", "##b", "ab", "##ab", "aba", "##bba", "bab", "##aaaa", ".", "é", "##é", "ba", "aab"]


def made():
    pick = random.Random(5)
    texts = [" ".join("".join(pick.choice("aabbéc.") for _ in range(pick.randint(1, 9))) for _ in range(pick.randint(0, 30))) for _ in range(60)]
    return [*texts, None, "", "   ", "AB aB", "a" * 100, "a" * 101, "ab " * 500, "q" * 3, "ab. " * 191]


def test_as_the_library(spark):
    vocabulary = {p: i for i, p in enumerate(PIECES)}
    model = Tokenizer(WordPiece(vocabulary, unk_token=P.UNKNOWN, max_input_chars_per_word=P.LONGEST_WORD))
    texts = made()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(vocabulary.items()), "piece string, id long")
    for length in (16, 384):
        got = {r.doc_id: (r.ids, r.mask) for r in P.encoded(rows, table, length=length).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = [x for w in re.findall(r"[^\W]+|[^\s\w]", (t or "").lower()) for x in model.encode(w, add_special_tokens=False).ids][: length - 2]
            want = [2, *ids, 3]
            assert got[i] == (want + [0] * (length - len(want)), [1] * len(want) + [0] * (length - len(want))), t


@pytest.mark.parametrize("bound", [len(PIECES), 0])
def test_broadcast_and_joined_agree(spark, monkeypatch, bound):
    """A vocabulary within the bound is looked up where the texts are, one beyond it by joins; with the same pieces."""
    vocabulary = {p: i for i, p in enumerate(PIECES)}
    model = Tokenizer(WordPiece(vocabulary, unk_token=P.UNKNOWN, max_input_chars_per_word=P.LONGEST_WORD))
    monkeypatch.setattr(P, "BROADCAST_PIECES", bound)
    monkeypatch.setattr(P, "REMEMBERED", 3)
    rows = spark.createDataFrame(list(enumerate(made())), "doc_id long, text string")
    out = P.encoded(rows, spark.createDataFrame(list(vocabulary.items()), "piece string, id long"), length=40)
    assert ("Exchange" not in out._jdf.queryExecution().executedPlan().toString()) == bool(bound)
    got = {r.doc_id: r.ids for r in out.collect()}
    for i, t in enumerate(made()):
        ids = [x for w in re.findall(r"[^\W]+|[^\s\w]", (t or "").lower()) for x in model.encode(w, add_special_tokens=False).ids][:38]
        assert got[i] == [2, *ids, 3] + [0] * (38 - len(ids)), t


def test_signs(spark):
    rows = spark.createDataFrame([("aB\u00a0b\t\n",), (None,), ("",), ("é\U0001f600 A",)], "text string")
    assert sorted(r.s for r in P.signs(rows).collect()) == sorted(["a", "b", "\u00a0", "é", "\U0001f600"])


def test_special_pieces_are_needed(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="lacks special pieces"):
        P.encoded(rows, spark.createDataFrame([("a", 1)], "piece string, id int"))


def test_only_special_pieces(spark):
    rows = spark.createDataFrame([(1, "a b"), (None, "a")], "doc_id long, text string")
    out = P.encoded(rows, spark.createDataFrame([(p, i) for i, p in enumerate(SPECIAL)], "piece string, id int"), length=5)
    assert {r.doc_id: r.ids for r in out.collect()}[1] == [2, 1, 1, 3, 0]
