"""Texts that share a doc_id or have none, dotted and clashing column names, ties of cosines."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from claimloom.llm import ann, line_dedup, mixing, near_dedup, pii

#: Texts whose 32-bit hashes are equal.
ALIKE = ("duplicated line here\nalpha text number 31129", "beta words of number 78032\nduplicated line here")


def test_texts_of_equal_short_hashes_keep_their_lines(spark):
    low = spark.createDataFrame([(t,) for t in ALIKE], "text string").selectExpr("pmod(xxhash64(text), 4294967296) h").distinct().count()
    assert low == 1
    for doc_id in (None, 7):
        docs = spark.createDataFrame([(1, "duplicated line here"), (doc_id, ALIKE[0]), (doc_id, ALIKE[1])], "doc_id long, text string")
        kept = sorted(r.text for r in line_dedup.dedup(docs).collect())
        assert kept == ["alpha text number 31129", "beta words of number 78032", "duplicated line here"]


def test_rows_without_a_doc_id_are_near_duplicates_like_others(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(None, text), (None, text), (None, text + " more"), (3, text + " end"), (None, "another text altogether"), (None, None)], "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.text or "") for r in near_dedup.dedup(docs).collect())
    assert kept == [(False, text + " end"), (True, ""), (True, "another text altogether")]
    only_null = sorted(r.text or "" for r in near_dedup.dedup(docs.filter("doc_id IS NULL")).collect())
    assert len(only_null) == 3 and only_null[0] == "" and only_null[1] == "another text altogether"


DOTTED = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `x``y` string, _key int, spans int, _gone int, _none int"


@pytest.fixture()
def dotted(spark):
    lines = [f"line of the text with the number {k} in it and some more words" for k in range(12)]
    rows = [(k, "\n".join(lines[k % 4 : k % 4 + 5]), "en", "s", 1, k, f"v{k}", 1, 2, 3, 4) for k in range(12)]
    return spark.createDataFrame([*rows, (20, None, None, None, None, 1, "v", 1, 2, 3, 4)], DOTTED)


@pytest.mark.parametrize("stage", [line_dedup.dedup, near_dedup.dedup, mixing.mix, pii.sanitise])
def test_dotted_columns_are_kept(dotted, stage):
    out = stage(dotted)
    assert out.columns == dotted.columns
    given = {r["doc_id"]: (r["a.b"], r["x`y"], r["_none"]) for r in dotted.collect()}
    assert all((r["a.b"], r["x`y"], r["_none"]) == given[r["doc_id"]] for r in out.collect())


def test_pipeline_stages_keep_dotted_columns(spark, dotted, edge_dir):
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, dotted, edge_dir).columns == dotted.columns, name


def test_equal_cosines_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=16)
    rows = [(k, [float(x) for x in np.float64(c) * 2.0 ** (k % 40)]) for k in range(60)]
    rows += [(100 + k, [float(x) for x in rng.normal(size=16)]) for k in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(vectors, vectors["vec_id"].isin(0, 50)).collect()
    by = {q: [(r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50)}
    assert by == {0: [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)], 50: [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]}
