"""Vectors in the binary layout: ranges of any size give all rows once, or the read fails."""

from __future__ import annotations

import random
import struct

import pytest
from claimloom.sources import vector_files as V


def layout(rows, feed=b"\n"):
    head = f"{len(rows)} {len(rows[0][1])}\n".encode()
    return head + b"".join(w.encode() + b" " + struct.pack(f"<{len(v)}f", *v) + feed for w, v in rows)


def made(n, dims, seed):
    pick = random.Random(seed)
    return [("".join(pick.choice("abcé=_>") for _ in range(pick.choice([1, 3, 9, 60]))) + str(i), [struct.unpack("<f", struct.pack("<f", pick.gauss(0, 1)))[0] for _ in range(dims)]) for i in range(n)]


def ranges(path, step):
    """What each range gives, without Spark."""
    reader = V.VectorReader(str(path), step)
    for part in reader.partitions():
        yield [(t, v) for b in reader.read(part) for t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]


@pytest.mark.parametrize("feed", [b"\n", b""])
@pytest.mark.parametrize("dims", [1, 5, 64])
def test_any_ranges_give_all_rows_once(tmp_path, feed, dims):
    rows = made(150, dims, dims)
    file = tmp_path / "v.bin"
    file.write_bytes(layout(rows, feed))
    for step in (37, 100, 1000, 4096, 1 << 20):
        assert [x for part in ranges(file, step) for x in part] == rows
    assert sum(bool(part) for part in ranges(file, 1000)) > 1


def test_numbers_that_look_like_words_fail_or_are_right(tmp_path):
    blanks = struct.unpack("<f", b"a b ")[0]
    rows = [(f"w{i}", [blanks] * 8) for i in range(200)]
    file = tmp_path / "v.bin"
    file.write_bytes(layout(rows, b""))
    try:
        assert [x for part in ranges(file, 500) for x in part] == rows
    except ValueError as e:
        assert "split_bytes" in str(e)
    assert [x for part in ranges(file, 1 << 20) for x in part] == rows


def test_cut_off_and_headless_files_fail(tmp_path):
    whole = layout(made(30, 4, 1))
    (tmp_path / "cut.bin").write_bytes(whole[:-7])
    (tmp_path / "headless.bin").write_bytes(b"word without numbers")
    for name in ("cut.bin", "headless.bin"):
        with pytest.raises(ValueError):
            list(ranges(tmp_path / name, 1 << 20))


def test_written_read_appended_overwritten(spark, tmp_path):
    V.registered(spark)
    path = str(tmp_path / "out")
    rows = made(500, 6, 3)
    frame = lambda part: spark.createDataFrame(part, "term string, vector array<float>")
    read = lambda: spark.read.format("vector_files").option("split_bytes", 2000).load(path)
    plain = lambda: sorted((r.term, r.vector) for r in read().collect())
    frame(rows[:300]).repartition(3).write.format("vector_files").mode("append").save(path)
    assert plain() == sorted(rows[:300]) and read().rdd.getNumPartitions() > 3
    frame(rows[300:]).write.format("vector_files").mode("append").save(path)
    assert plain() == sorted(rows)
    (tmp_path / "out" / "part-left-by-a-lost-task.bin").write_bytes(b"1 6\n")
    frame(rows[:10]).write.format("vector_files").mode("overwrite").save(path)
    assert plain() == sorted(rows[:10])
    frame([]).write.format("vector_files").mode("overwrite").save(path)
    assert plain() == []


@pytest.mark.parametrize("row", [(None, [1.0]), ("", [1.0]), ("two words", [1.0]), ("a", None), ("a", []), ("a", [1.0, None])])
def test_what_the_layout_cannot_hold(spark, tmp_path, row):
    V.registered(spark)
    with pytest.raises(Exception, match="cannot hold"):
        spark.createDataFrame([row], "term string, vector array<float>").coalesce(1).write.format("vector_files").mode("append").save(str(tmp_path / "bad"))
