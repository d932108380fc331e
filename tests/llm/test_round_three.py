"""The Merkle manifest, byte-pair encoding and the conversation trie against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import bpe, conversations, merkle, registry
from claimloom.llm.subword import vocabulary

H = lambda xs: hashlib.sha256("".join(xs).encode()).hexdigest()


# Merkle manifest


def naive_tree(hashes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and of each leaf what stands left and right of its path, by levels of lists."""
    paths: list[list[tuple[str, str]]] = [[] for _ in hashes]
    level, at = hashes, list(range(len(hashes)))
    while len(level) > 1:
        for leaf, k in enumerate(at):
            run = k - k % 3
            paths[leaf].append(("".join(level[run:k]), "".join(level[k + 1 : run + 3])))
        level, at = [H(level[k : k + 3]) for k in range(0, len(level), 3)], [k // 3 for k in at]
    return level[0], paths


def naive_manifest(rows: list[tuple]) -> Counter:
    def leaf(row, text):
        return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text))

    by: dict[tuple, list] = {}
    for doc_id, text, lang, source, n_chars in rows:
        row = (doc_id, source, lang, n_chars)
        other = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        by.setdefault((source is not None, (source or "").encode()), []).append((doc_id is not None, doc_id or 0, leaf(row, text), leaf(row, other), doc_id))
    trees = []
    for source in sorted(by):
        held = sorted(by[source])
        trees.append((held, *naive_tree([x[2] for x in held])))
    root, above = naive_tree([t[1] for t in trees])
    out = Counter()
    for (held, subroot, paths), tail in zip(trees, above, strict=True):
        for (_, _, own, other, doc_id), path in zip(held, paths, strict=True):
            folded = other
            for left, right in path + tail:
                folded = H([left, folded, right])
            out[doc_id, own, subroot, root, H(x for p in path + tail for x in p), folded, folded == root] += 1
    return out


def manifest_rows(spark, folder):
    df = registry.QUERIES["op11_merkle_manifest"](spark, folder)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, df.collect()))


def test_op11_awkward_rows(spark, edge_dir, rows):
    assert manifest_rows(spark, edge_dir) == naive_manifest([r[:5] for r in rows])


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (2, 3, 4), (9, 10, 27, 28), (700, 1, 2500, 40)])
def test_op11_trees_of_all_shapes(spark, tmp_path, sizes):
    docs, k = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            docs.append((k, f"text {k}\nof {s}", "en", f"s{s}", 7))
            k += 1
    random.Random(4).shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest_rows(spark, str(tmp_path)) == naive_manifest(docs)


def test_op11_hot_and_repeated_rows(spark, tmp_path):
    docs = [(None, "same", None, None, None)] * 50 + [(1, "same\n", "en", "a", 5)] * 400 + [(k, f"{k}\n", "en", "é", 1) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest_rows(spark, str(tmp_path)) == naive_manifest(docs)


def test_combiner_in_any_order():
    rng = random.Random(2)
    for n in (1, 2, 3, 5, 28, 100):
        hashes = [H([str(k)]) for k in range(n)]
        order = list(range(n))
        rng.shuffle(order)
        combiner, tops = merkle.Combiner(n, 99), []
        for k in order:
            if top := combiner.add(0, k, hashes[k]):
                tops.append(top)
        root, paths = naive_tree(hashes)
        assert tops == [(merkle.height(n), 0, root)]
        assert [combiner.path(0, k, merkle.height(n)) for k in range(n)] == paths


# Byte-pair encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def held():
    return bpe.model(vocabulary("byte_bpe_50k.json"))


def ids(held, text):
    return np.frombuffer(held.encode(text), dtype=np.int32).tolist()


def awkward_texts() -> list[str]:
    rng = random.Random(9)
    out = ["", " ", "\n\n", "a", "don't we'll I'M it's", "x" * 40_000, " " * 5_000 + "end", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endoftext", "日本語テキスト" * 300, "😀👨‍👩‍👧 ok", "՘ ꟝1 \U00033460x", "é́ß İ\x00\x85\xa0 .", "1234567 ½²٣"]
    for alphabet in ("ab", "-=", "- ", " \t\n", "aeiourst", "ÃÂ", "é一\U0001f600"):
        out += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (3, 47, 48, 49, 50, 700, 1500, 6000)]
    return out


def test_op12_agrees_with_the_library(spark, tmp_path, library):
    texts = [*awkward_texts(), None]
    docs = [(k, t, "clash") for k, t in enumerate(texts)] + [(0, "", "clash"), (None, "no id", "clash"), (1, "a second text", "clash")]
    spark.createDataFrame(docs, "doc_id long, text string, ids string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    expected = Counter()
    for doc_id, text, _ in docs:
        found = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(found, skip_special_tokens=False)
        assert decoded == (text or "")
        expected[doc_id, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    df = registry.QUERIES["op12_bpe"](spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, df.collect())) == expected


def test_op12_whole_table(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.QUERIES["op12_bpe"](spark, sf_dir).collect():
        found = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())


def test_tokens_are_stable_beyond_the_lookahead(held):
    """Whatever follows, tokens that end the lookahead before the end stay as they are."""
    rng = random.Random(3)
    tokens = [b for b in held.bytes_of.values() if b.isalpha() or not b.strip(b"-=_*#.")]
    for _ in range(40):
        data = b"".join(rng.choices(tokens, k=250))
        shared, whole = held.merged(data), held.merged(data + b"".join(rng.choices(tokens, k=20)))
        end = 0
        for a, b in zip(shared, whole, strict=False):
            end += len(held.bytes_of[a])
            if end > len(data) - held.lookahead:
                break
            assert a == b


def test_stream_in_any_chunks(held):
    rng = random.Random(5)
    data = ("-" * 900 + "=" * 1800 + "abcabd" * 900).encode()
    for most in (1, 7, 5000):
        cuts = []
        at = 0
        while at < len(data):
            cuts.append(data[at : (at := at + rng.randint(1, most))])
        assert [i for part in held.stream(iter(cuts)) for i in part] == held.merged(data)


def test_decoder_in_any_runs(spark, held, library):
    rng = random.Random(8)
    for _ in range(100):
        found = [rng.randrange(50_257) for _ in range(120)]
        machine, parts, at = bpe.Decoder(held), [], 0
        while at < len(found):
            parts.append(machine.feed(found[at : (at := at + rng.randint(1, 9))]))
        assert "".join([*parts, machine.feed([], True)]) == library.decode(found, skip_special_tokens=False)
    rows = spark.createDataFrame([([15496, None, 999_999, 995], 1), (None, 2), ([], 3)], "`a.b` array<int>, x int")
    assert [tuple(r)[1:] for r in bpe.decode(rows, "a.b").orderBy("x").collect()] == [(1, "Hello world"[:5] + library.decode([995])), (2, ""), (3, "")]


def test_encode_keeps_columns(spark):
    rows = spark.createDataFrame([("Hello", 1, "x")], "text string, `a.b` int, n string")
    out = bpe.encode(rows)
    assert out.columns == ["ids", "a.b", "n"] and tuple(out.first()) == ([15496], 1, "x")


# Conversation trie


def naive_trie(rows: list[tuple]) -> Counter:
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + t[h:])
    members: dict[tuple, list[int]] = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = Counter()
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:-1] == x for y in below if y and y != x)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def trie_rows(spark, folder):
    df = registry.QUERIES["op13_conversation_trie"](spark, folder)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(map(tuple, df.collect()))


def write_conversations(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(4).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_op13_awkward_rows(spark, tmp_path):
    rng = random.Random(6)
    texts = ["hi", "", None, "é日本", "long " * 4000, "a", "b"]
    rows = []
    for c in [*range(0, 40), *range(95, 130), *range(250, 260), -3, -99, -100, -150, 10**15, 10**15 + 7]:
        rows += [(c, k, rng.choice(["user", "assistant", None]), rng.choice(texts[:4] if k < 2 else texts)) for k in range(rng.randint(1, 7))]
    rows += [(300, None, "user", "first"), (300, 0, "user", "second"), (300, 5, "user", "third"), (None, 0, "user", "nobody"), (301, 2, None, None)]
    assert trie_rows(spark, write_conversations(spark, tmp_path, rows)) == naive_trie(rows)


def test_op13_copies_and_a_deep_conversation(spark, tmp_path):
    rows = [(c, k, "user", f"turn {k}") for c in range(0, 3000, 7) for k in range(3)]  # one node with many ends, over many families
    rows += [(5000, k, "user", str(k)) for k in range(400)]
    got, expected = trie_rows(spark, write_conversations(spark, tmp_path, rows)), naive_trie(rows[: 429 * 3])
    deep = zlib.crc32(b"5000") % 6
    assert sum(got.values()) >= 400 + sum(expected.values()) - 1 and max(r[1] for r in got) == 400 and deep < 6
    small = trie_rows(spark, write_conversations(spark, tmp_path / "b", rows[: 429 * 3]))
    assert small == expected


def test_op13_ends_of_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "RANGE", 1)
    rows = [(c, k, "user", f"turn {k}") for c in [*range(0, 2000, 13), -200, -50] for k in range(6)]
    assert trie_rows(spark, write_conversations(spark, tmp_path, rows)) == naive_trie(rows)


def test_repeated_turns_of_one_number_are_turns(spark):
    one = spark.createDataFrame([(4, 0, "user", "x"), (4, 0, "user", "x"), (4, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    again = one.orderBy(F.desc("text"))
    a, b = conversations.trie(one), conversations.trie(again)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_empty_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.trie(none).count() == 0
