"""Small tables with awkward rows, and empty ones."""

from __future__ import annotations

import random

import pytest

EXTRA = ("size", "n", "kept", "bucket", "part", "line", "k", "fp", "id", "term", "key", "spans", "near", "shard", "ids", "copies", "data", "tag", "h", "score", "n_words")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)


def sentence(rng: random.Random, n: int) -> str:
    syllables = "an er th on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_rows() -> list[tuple]:
    rng = random.Random(5)
    lines = [sentence(rng, 14).capitalize() + "." for _ in range(60)]
    texts: list[tuple[int | None, str | None]] = []
    for i in range(40):
        own = [sentence(rng, rng.randint(4, 30)) + "." for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), rng.choice(lines[:5]))
        if i % 7 == 0:
            x = list(rng.choice(lines[5:8]))
            x[rng.randrange(len(x))] = "z"  # an edit away from its origin
            own.append("".join(x))
        texts.append((i, "\n".join(own)))
    texts += [(50 + k, lines[5 + k]) for k in range(3)]
    texts += [(60, texts[0][1]), (61, texts[0][1]), (62, texts[0][1].replace("a", "e", 1))]  # copies and a near copy
    texts += [(70, None), (71, ""), (72, " \t\n\n"), (73, "Zoë ß İ 日本語\n" * 3), (74, "word"), (75, "A b C d")]
    texts += [(80, "same row here, twice in the table"), (80, "same row here, twice in the table"), (81, "one text"), (81, "another text"), (None, "no id at all, but a text of some length"), (None, None)]
    texts += [(90, "aaaa " * 3000), (91, "aaaa " * 3000 + "b"), (92, sentence(rng, 9000)), (93, "x" * 40_000)]
    texts += [(95, "write to jo@x.example.org now, 10.0.0.1 or 300.1.1.1, card 4111 1111 1111 1111, call +44 (20) 7946-0958!"), (96, "a@b @c.d 1.2.3.4.5 +1 4111111111111112 x.@y..z")]
    sources = ["src0"] * 5 + ["src1", "src2", None, "", "Ärger"]
    return [(d, t, "en", sources[i % len(sources)], None if t is None else len(t), *([7] * len(EXTRA))) for i, (d, t) in enumerate(texts)]


def write(spark, folder: str, rows: list[tuple], vectors: list[tuple], labels: list[tuple]) -> str:
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, q int, ids int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    talk = [(c, k, "user", f"turn {k % 3}", 1) for c in (0, 1, 2, 150, 207) for k in range(c % 4 + 1)] + [(None, 0, None, None, 1), (3, None, None, None, 1)]
    spark.createDataFrame(talk if rows else [], "conv_id long, turn long, role string, text string, depth int").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def edge_dir(spark, rows, tmp_path_factory):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(16)], 0, 1, 2) for i in range(400)]
    vectors += [(1000 + i, vectors[50][1], 0, 1, 2) for i in range(30)]  # ties
    vectors += [(500, None, 0, 1, 2), (550, [0.0] * 16, 0, 1, 2), (600, [float("nan")] + [1.0] * 15, 0, 1, 2), (650, [1.0] * 5, 0, 1, 2), (700, [None] + [1.0] * 15, 0, 1, 2), (None, [1.0] * 16, 0, 1, 2), (750, [], 0, 1, 2)]
    labels = [(i, int(i % 4 != 0), int(i % 5 == 0), "clash") for i in range(60)] + [(3, 0, 1, "x"), (None, 1, 0, "x"), (5, None, None, "x"), (999, 1, 1, "x")]
    return write(spark, str(tmp_path_factory.mktemp("edge") / "sf"), rows, vectors, labels)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty") / "sf"), [], [], [])
