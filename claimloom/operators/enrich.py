"""Language enrichment: span splicing, productions, and places to plug models in."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T

#: Entities by pattern, where no model is at hand.
PATTERNS = (("EMAIL", r"[\w.-]+@[\w.-]+"), ("NUMBER", r"[0-9]+"), ("NAME", r"[A-Z][a-z]+ [A-Z][a-z]+"))


def anonymise(c) -> Column:
    """UDF-01 without a model: entities by pattern, replaced by their label."""
    out = T.col(c)
    for label, pattern in PATTERNS:
        out = F.regexp_replace(out, pattern, f"[{label}]")
    return out


def splice(c, spans) -> Column:
    """UDF-01: replaces spans (start from 0, end, label; in order, none overlapping) of a text by their labels."""
    c, spans = T.col(c), T.col(spans)
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substr(c, s["at"] + 1, x["start"] - s["at"]), x["label"]).alias("out"), x["end"].alias("at")),
    )
    return F.concat(done["out"], F.substr(c, done["at"] + 1))


def productions(rules, lexical: bool) -> Column:
    """UDF-03: the productions whose right side holds a quoted word, or the others."""
    has = lambda r: F.contains(F.split(r, "-> ")[1], F.lit("'"))
    return F.filter(T.col(rules), lambda r: has(r) if lexical else ~has(r))


def apply_model(rows: DataFrame, load: Callable[[], Callable[[list[str]], Iterable]], schema: str, c: str = "text") -> DataFrame:
    """UDF-02, UDF-04, UDF-05, UDF-08, TOK-09: (doc_id, result) of any model that maps texts to values.

    ``load`` runs once a task; null texts, and those that a model fails on, get null.
    """

    def run(batches):
        import pandas as pd

        model = load()

        def each(texts: list[str]) -> list:
            try:
                return list(model(texts))
            except Exception:  # one of them
                return [None] if len(texts) == 1 else each(texts[: len(texts) // 2]) + each(texts[len(texts) // 2 :])

        for b in batches:
            held = b[c].notna()
            results = iter(each(b[c][held].tolist()) if held.any() else [])
            yield pd.DataFrame({"doc_id": b["doc_id"], "result": pd.Series([next(results) if h else None for h in held], index=b.index, dtype=object)})

    return rows.select("doc_id", c).mapInPandas(run, f"doc_id long, result {schema}")


def predictor(load: Callable[[], Callable], schema: str, batch: int = 64):
    """MDL-07 to MDL-10: a Column function of a batch model (arrays of ids in, values out)."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(load, return_type=schema, batch_size=batch)


def softmax(c) -> Column:
    """MDL-16."""
    c = T.col(c)
    top = F.array_max(c)
    e = F.transform(c, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def dependency_edges(parse: Callable[[str], list[tuple[str, str, str, str]]]):
    """UDF-08: a loader for ``apply_model`` that gives (head, child, relation, tag) rows."""
    return lambda: lambda texts: [[dict(zip(("head", "child", "relation", "tag"), e, strict=True)) for e in parse(t)] for t in texts]
