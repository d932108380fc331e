"""Planted abbreviations, registered domains against a walk over labels, areas under curves against pairs."""

from __future__ import annotations

import random

import pytest

from claimloom.operators import domains, evaluate
from claimloom.operators import sentences as S


def test_planted_abbreviations_do_not_end_sentences(spark):
    rng = random.Random(2)
    words = ["river", "house", "green", "walks", "under", "table", "seven", "lamps"]
    said = []
    for i in range(300):
        a, b, c = rng.choice(words).title(), rng.choice(words), rng.choice(words)
        said.append(f"{a} saw Dr. {b.title()} and e.g. {c}. {b.title()} went etc. to {a} {c}.")
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    found = {r.term for r in S.abbreviations(S.period_counts(rows)).filter("abbreviation").collect()}
    assert found == {"dr", "e.g", "etc"}
    more = [(900, 'He met Dr. Green. "Was it J. Brown?" She left! (Truly.) no 3.14 there'), (901, None), (902, "  "), (903, "no end"), (904, "One. one. Two.")]
    cut = {r.doc_id: r.sentences for r in S.split(spark.createDataFrame(more, "doc_id long, text string"), spark.createDataFrame([(t,) for t in found], "term string")).collect()}
    assert cut == {900: ["He met Dr. Green.", '"Was it J. Brown?"', "She left!", "(Truly.) no 3.14 there"], 901: [], 902: [], 903: ["no end"], 904: ["One. one.", "Two."]}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.abbreviations(S.period_counts(none)).count() == 0 and S.split(none, spark.createDataFrame([], "term string")).count() == 0
    only = spark.createDataFrame([(1, "so. so. so.")], "doc_id long, text string")  # every word has a period
    assert [r.term for r in S.abbreviations(S.period_counts(only)).collect()] == ["so"]


RULES = ("com", "uk", "co.uk", "*.ck", "!www.ck", "blogs.com", "ck")


def walked(host):
    parts = host.split(".")
    best = (False, 1)
    for i in range(len(parts)):
        tail = ".".join(parts[i:])
        if "!" + tail in RULES:
            best = max(best, (True, len(parts) - i - 1))
        if tail in RULES or (i + 1 <= len(parts) and "*." + ".".join(parts[i + 1 :]) in RULES):
            best = max(best, (False, len(parts) - i))
    n = best[1]
    return ".".join(parts[len(parts) - n :]), ".".join(parts[len(parts) - n - 1 :]) if n < len(parts) else ""


def test_longest_suffixes(spark):
    rng = random.Random(5)
    hosts = {".".join(rng.choice(["a", "www", "ck", "uk", "co", "com", "blogs", "zz"]) for _ in range(rng.randint(1, 5))) for _ in range(300)}
    rows = [(i, f"https://{'me@' if i % 3 == 0 else ''}{h.upper() if i % 2 else h}{':80' if i % 5 == 0 else ''}/x.com", "kept") for i, h in enumerate(sorted(hosts))]
    rows += [(1000, None, "a"), (1001, "no url", "b"), (1002, "http://10.0.0.1/x", "c"), (1003, "http://a.co.uk./", "d")]
    out = domains.registered(spark.createDataFrame(rows, "id int, url string, `a.b` string"), spark.createDataFrame([(r,) for r in RULES], "rule string"))
    assert out.columns == ["id", "url", "a.b", "host", "suffix", "domain"]
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, h in enumerate(sorted(hosts)):
        assert (got[i].host, got[i].suffix, got[i].domain) == (h, *walked(h)), h
    assert [got[k].domain for k in (1000, 1001, 1002, 1003)] == ["", "", "", "a.co.uk"]


@pytest.mark.parametrize("n", [60, 2])
def test_area_is_the_share_of_ordered_pairs(spark, n):
    rng = random.Random(n)
    rows = [(rng.randint(0, 9) / 10, i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "score double, label int").repartition(3)
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(evaluate.auc(df).first().auc - want) < 1e-12
    points = {r.score: (r.fpr, r.tpr) for r in evaluate.roc(df).collect()}
    assert points == {s: (sum(q >= s for q in neg) / len(neg), sum(p >= s for p in pos) / len(pos)) for s, _ in rows}


def test_area_of_one_class_or_no_rows(spark):
    df = spark.createDataFrame([(0.5, 1), (0.2, 1)], "score double, label int")
    assert evaluate.auc(df).first().auc is None and evaluate.auc(df.limit(0)).first().auc is None
