"""The toxicity network reads words of any length whole."""

from __future__ import annotations

import numpy as np

from claimloom.llm import bigru


def test_tail_of_a_long_word_is_scored():
    scorer = bigru.Scorer(bigru.Model({}))
    for head in ("这是一个没有空格的很长的句子" * 4, "path/to_some.thing-" * 8, "x" * 5000):
        a, b = scorer.scores([head + "insultingword", head + "friendlyplace"])
        assert a != b


def test_parts_cover_every_trigram():
    rng = np.random.default_rng(4)
    for n in (1, 15, 16, 17, 21, 22, 63, 64, 65, 66, 97, 300, 2000):
        for letters in ("abcdefg", "日本語テキスト", "aé日😀"):
            word = "".join(rng.choice(list(letters), n))
            parts = bigru.chunks(word)
            assert all(len(p.encode()) <= bigru.PART for p in parts)
            assert {word[i : i + 3] for i in range(n - 2)} <= {p[i : i + 3] for p in parts for i in range(len(p) - 2)}
            assert len(word.encode()) > bigru.PART or parts == [word]
    assert bigru.chunks("a b " + "=" * 200 + " c") == ["a", "b", "=" * 200, "c"] and bigru.chunks(" ") == []
