"""Features by tables of words against plain counting."""

from __future__ import annotations

import re

import pytest
from claimloom.operators import lexicon as L
from claimloom.sources import readers

TEXTS = ["May be, may be not. Café!", "", None, "maybe", "a b c d e f g h i j k l m n o p q r s t u zeitgeist. " * 3]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n string")


def test_shares(spark, rows):
    lexicon = spark.createDataFrame([("hedges", "may"), ("hedges", "may"), ("hedges", "not"), ("signs", ","), ("signs", "not"), ("none", "zebra"), (None, "a"), ("hedges", None)], "lexicon string, term string")
    words = {"hedges": {"may", "not"}, "signs": {",", "not"}, "none": {"zebra"}}
    got = {(r.doc_id, r.feature): r.value for r in L.shares(rows, lexicon).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        tokens = re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", t or "")
        for name, listed in words.items():
            want[i, name] = sum(x in listed for x in tokens) / len(tokens) if tokens else None
    assert got == want
    assert L.shares(rows, lexicon.limit(0)).count() == 0


def test_dale_chall(spark, rows):
    familiar = spark.createDataFrame([(w,) for w in "May be not a b c d e f g h i j k l m n o p q r s t u".split()], "term string")
    known = {r.term.lower() for r in familiar.collect()}
    got = {r.doc_id: (r.difficult, r.dale_chall) for r in L.dale_chall(rows, familiar).collect()}
    assert sorted(got) == [0, 3, 4]
    for i, (difficult, score) in got.items():
        low = TEXTS[i].lower()
        words = re.findall("[a-z]+", low)
        hard = sum(w not in known for w in words)
        share = 100 * hard / len(words)
        assert difficult == hard
        assert score == pytest.approx(0.1579 * share + 0.0496 * len(words) / max(1, len(re.findall("[.!?]", low))) + (3.6365 if share > 5 else 0))
    assert got[4][1] < 5 < got[3][1]  # 3 of 66 hard words add nothing


def test_ready_made(spark):
    table = spark.createDataFrame([(1, "50", "7.5"), (2, "n/a", None)], "doc_id long, `a.b` string, posemo string")
    assert sorted((tuple(r) for r in L.ready_made(table).collect()), key=str) == sorted([(1, "a.b", 0.5), (1, "posemo", 0.075), (2, "a.b", None), (2, "posemo", None)], key=str)


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "hedges.txt").write_bytes("# naïve list\r\nso-called\r\nclich\xe9\r\n".encode("latin-1"))
    (tmp_path / "empty.txt").write_bytes(b"")
    assert {tuple(r) for r in readers.lexicons(spark, str(tmp_path)).collect()} == {("hedges", t) for t in ("so", "-", "called", "clich", "é")}


def test_tokens_meet_small_lexicons_before_any_shuffle(spark, rows):
    """What is shuffled is counts a document and lexicon, not a document and word."""
    from claimloom.operators import features as X

    lexicon = spark.createDataFrame([("hedges", "may"), ("hedges", "be"), ("signs", ",")], "lexicon string, term string")
    out = X.lexicon_join(rows, lexicon)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in out.collect()) == [(0, "hedges", 3), (0, "signs", 1)]
