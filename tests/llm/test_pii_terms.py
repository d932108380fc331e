"""Revealing terms near values that stand in one text only, and away from values."""

from __future__ import annotations

from claimloom.llm import pii


def test_terms_of_values_seen_once(spark):
    near = [f"day {i} Quillfeather answers at box{i}@mail.example.com until noon" for i in range(8)]
    away = ["Quillfeather went home, quillfeather stayed"]
    other = [f"day {i} nobody answers at all until noon, said number {i * i}" for i in range(200)]
    said = near + away + other
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    found = {r.doc_id: [said[r.doc_id][t.start : t.end] for t in r.terms or []] for r in pii.find(docs).collect()}
    assert all("Quillfeather" in found[i] and not {"day", "answers", "until", "noon"} & set(found[i]) for i in range(8))
    assert found[8] == ["Quillfeather", "quillfeather"] and not any(found[i] for i in range(9, len(said)))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "uillfeather" not in clean[8] and clean[8].startswith("[NAME] went home") and clean[20] == said[20]


def test_terms_are_counted_alike_by_list_and_by_join(spark, monkeypatch):
    said = [f"note {i} Quillfeather and word{i} answer at box{i % 5}@mail.example.com until noon" for i in range(40)] + [f"nobody {i} at noon" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(said)) + [(900, said[0])], "doc_id long, text string")
    counted, count = [], pii.term_frequencies

    def held(docs, terms):
        counted.append({r.term for r in terms.collect()})
        return count(docs, terms)

    monkeypatch.setattr(pii, "term_frequencies", held)
    found = []
    for most in (10, 0):
        monkeypatch.setattr(pii, "LISTED", most)
        found.append(sorted((r.doc_id, len(r.terms or [])) for r in pii.find(docs).collect()))
    assert found[0] == found[1] and dict(found[0])[3] > 0
    assert "quillfeather" in counted[0] and "word7" not in counted[0]  # a word that stands once can't tell: it isn't counted
