"""Joins of corpus operators beyond what is broadcast."""

from __future__ import annotations

import random

from claimloom.llm import line_dedup


def test_keys_meet_without_their_lines(spark, monkeypatch):
    """A line has many keys: what meets by key is hashes, and the shuffled join gives what the broadcast one gives."""
    rng = random.Random(3)
    rows = []
    for k in range(40):
        line = "".join(rng.choice("abcdefgh ") for _ in range(150))
        rows += [(2 * k, f"{line}\nx{k}"), (2 * k + 1, f"short {k}\n{line[:60]}Z{line[61:]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(tuple, line_dedup.verdicts(docs).select("id", "gone").collect()))
    assert len(few) == 40
    several = line_dedup.keyed(docs).groupBy("key").agg({"h": "min"}).selectExpr("key", "`min(h)` AS low", "`min(h)` AS high")
    assert "line" not in line_dedup.met(docs, several).columns
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, line_dedup.verdicts(docs).select("id", "gone").collect())) == few


def test_texts_are_hashed_once_not_once_a_line(spark):
    """What names a text is computed below the explode of its lines."""
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, None)], "doc_id long, text string")
    plan = line_dedup.hashed(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64(text") == plan.count("xxhash64(1, text") == 1
    assert plan.index("Generate") < min(plan.index("xxhash64(text"), plan.index("xxhash64(1, text"))
    assert len({(r.t1, r.t2) for r in line_dedup.hashed(docs).collect()}) == 1
