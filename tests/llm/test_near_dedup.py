"""The pipeline's near-dedup stage against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
from claimloom.llm import near_dedup, simhash


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_duplicates_at_the_threshold(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 7):  # each changes five shingles: on both sides of the threshold
            copy = list(base)
            for at in rng.sample(range(10, 190), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    texts += ["", " \n", "one two", "ONE  two"]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= 0.8:
                far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 4
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert far > 30  # beyond four bits
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[0]), (900, None)], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(root))  # the row without a doc_id is a copy of one that has it


def test_candidates_are_those_of_wide_fingerprints(spark):
    """Random texts meet by SimHash cells: a pair's fingerprints tell whether it is counted at all."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near, far = list(base), [f"w{rng.randrange(5000)}" for _ in range(300)]
    for at in (20, 80, 140, 200):
        near[at] = "other"
    words = [near_dedup.fingerprint(near_dedup.shingles(" ".join(t))).view("uint64") for t in (base, near, far)]
    differ = lambda a, b: int(sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True)))
    assert 0 < differ(words[0], words[1]) <= near_dedup.NEAR < differ(words[0], words[2])
    docs = spark.createDataFrame([(7, " ".join(base)), (3, " ".join(near)), (5, " ".join(far)), (5, " ".join(far)), (5, " ".join(base))], "doc_id long, text string")
    assert sorted((r.doc_id, r.text == " ".join(near)) for r in near_dedup.dedup(docs).collect()) == [(3, True), (5, False)]


def test_like_texts_below_the_threshold_make_no_row_a_pair(spark, monkeypatch):
    """A group whose texts are alike by some 0.6: fingerprints let its pairs through, sketches don't; none at 0.8 is lost."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(160):
        copy = list(base)
        for at in rng.sample(range(5, 145), 4):  # up to 20 of 146 shingles, so two texts share some 110 of 180
            copy[at] = f"x{k}y{at}"
        texts.append(" ".join(copy))
    for k in range(0, 160, 16):
        texts.append(" ".join([*texts[k].split()[:-1], "other"]))  # one shingle less
    saved = {}
    real = near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda rows, what: saved.setdefault(what, real(rows, what)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in near_dedup.dedup(docs).collect())
    sets = [shingle_set(t) for t in texts]
    root, near = list(range(len(texts))), 0
    words = [near_dedup.fingerprint(near_dedup.shingles(t)).view("uint64") for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            near += sum((int(x) ^ int(y)).bit_count() for x, y in zip(words[i], words[j], strict=True)) <= near_dedup.NEAR
            odd = [near_dedup.sketch(near_dedup.shingles(texts[k]))[1:].view("uint64") for k in (i, j)] if j % 40 == 0 else None
            assert odd is None or sum((int(x) ^ int(y)).bit_count() for x, y in zip(*odd, strict=True)) <= len(sets[i] ^ sets[j])
            if alike(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert kept == sorted(set(root)) and len(kept) <= 160
    assert near > 5000 > 500 > saved["near-apart"].count()
