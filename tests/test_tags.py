"""Tags of tokens against plain counting, and without work that is told anew for each token."""

from __future__ import annotations

import re

from claimloom.operators import features as X
from claimloom.resources.words import TAGS

#: Tags of tokens, each by its rule: digits, signs (also such as lower-case to a letter), word lists, endings in their order.
KNOWN = {"12": "NUM", "1a": "X", "_": "X", ".": ".", "٣": ".", "K": ".", " ": ".", "é": ".", "😀": ".", "THE": "DET", "Of": "ADP", "but": "CONJ", "I": "PRON", "been": "VERB",
         "Badly": "ADV", "ly": "ADV", "going": "VERB", "bed": "VERB", "able": "ADJ", "BIBLE": "ADJ", "nation": "NOUN", "word": "X", "lying": "VERB"}


def test_tags(spark, monkeypatch):
    monkeypatch.setattr(X, "REMEMBERED", 3)
    texts = [" ".join(KNOWN) + "\x0b the,the", "cafés", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.tag): (r.n, r.ratio) for r in X.tag_counts(rows).collect()}
    assert len(got) == len(texts) * len(TAGS)
    for i, t in enumerate(texts):
        if t is None:
            assert all(got[i, tag] == (None, None) for tag in TAGS)
            continue
        tokens = re.findall(X.TOKEN, t, re.ASCII)
        known = KNOWN | {"caf": "X", "s": "X", "the": "DET", ",": "."}
        for tag in TAGS:
            n = sum(known[w] == tag for w in tokens) + 1
            assert got[i, tag] == (n, n / (len(tokens) + len(TAGS)))


def test_tokens_are_told_once(spark):
    """No expression runs over each token of each text, and nothing is shuffled."""
    rows = spark.createDataFrame([(1, "the word")], "doc_id long, text string")
    plan = X.tag_counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Exchange" not in plan
