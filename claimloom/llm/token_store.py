"""Token-ID output: independent zstandard frames with a trailing seek table.

A shard file is a sequence of independent zstandard frames, a skippable frame
that holds the documents' index, and the seek table of the public seekable
format (a skippable frame with each frame's compressed size, plain size and
the low 32 bits of its XXH64, then a 9-byte footer).  Any zstandard tool reads
the file as a plain stream; ``Reader`` decompresses only the frames that hold
the documents it is asked for and verifies their checksums.

A frame's plain content, little-endian: n (u4), doc_ids (n x i8), token counts
(n x u4), then the ids (u4).  Index: for each frame its first doc_id (i8) and
the number of the file's tokens before it (u8), ascending.

Null doc_ids sort first and come back as null; null texts are empty and have
the end id alone; rows that repeat a doc_id follow each other in text order;
an empty table makes no file and no rows.  Extra columns are not read.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, partitions, prepare, scratch_path, steady, table, texts
from claimloom.llm.subword import encoder, vocabulary

#: Fixed values of the seekable format.
SKIPPABLE, INDEX_FRAME, FOOTER_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80
NULL_ID = -(1 << 63)
FRAME_TOKENS = 1 << 16
END_ID = 2


class Writer:
    """Appends (doc_id, ids) in ascending doc_id order to a binary file."""

    def __init__(self, out, frame_tokens: int = FRAME_TOKENS, level: int = 3):
        import zstandard

        self.out, self.frame_tokens = out, frame_tokens
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.ids: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.held = self.total = self.docs = 0
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.tokens.append(ids)
        self.held += len(ids)
        self.docs += 1
        if self.held >= self.frame_tokens:
            self._flush()

    def _flush(self) -> None:
        if not self.ids:
            return
        import xxhash

        plain = b"".join(
            [
                struct.pack("<I", len(self.ids)),
                np.array(self.ids, dtype="<i8").tobytes(),
                np.array([len(t) for t in self.tokens], dtype="<u4").tobytes(),
                np.concatenate(self.tokens).astype("<u4").tobytes(),
            ]
        )
        frame = self.zstd.compress(plain)
        self.out.write(frame)
        self.entries.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.index.append((self.ids[0], self.total))
        self.total += self.held
        self.ids, self.tokens, self.held = [], [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<qQ", *x) for x in self.index)
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        seek = b"".join(struct.pack("<III", *x) for x in self.entries)
        self.out.write(struct.pack("<II", SKIPPABLE, len(seek) + 9) + seek)
        self.out.write(struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, FOOTER_MAGIC))


class Reader:
    """Random access to a shard: ``documents()`` for all, ``get(doc_id)`` for one."""

    def __init__(self, source):
        import zstandard

        self.f, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.seek(0, io.SEEK_END)
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC:
            raise ValueError("not a seekable token file")
        self.entries = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)]).astype(np.int64)
        raw = self._at(int(self.offsets[-1]) + 8, 16 * n)
        self.first_ids = np.frombuffer(raw, dtype="<i8").reshape(n, 2)[:, 0]
        self.starts = np.frombuffer(raw, dtype="<u8").reshape(n, 2)[:, 1]
        self.frames_read = 0

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def frame(self, k: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, tokens of the file before it, ids) of the k-th frame."""
        import xxhash

        packed, size, check = (int(x) for x in self.entries[k])
        plain = self.zstd.decompress(self._at(int(self.offsets[k]), packed), max_output_size=size)
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        self.frames_read += 1
        (n,) = struct.unpack_from("<I", plain)
        ids = np.frombuffer(plain, dtype="<i8", count=n, offset=4)
        counts = np.frombuffer(plain, dtype="<u4", count=n, offset=4 + 8 * n)
        tokens = np.frombuffer(plain, dtype="<u4", offset=4 + 12 * n)
        at, start = 0, int(self.starts[k])
        for doc_id, m in zip(ids.tolist(), counts.tolist(), strict=True):
            yield None if doc_id == NULL_ID else doc_id, start + at, tokens[at : at + m]
            at += m

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for k in range(len(self.entries)):
            yield from self.frame(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this doc_id, from the frames that can hold it."""
        key = NULL_ID if doc_id is None else doc_id
        low = max(0, int(np.searchsorted(self.first_ids, key, "left")) - 1)
        high = int(np.searchsorted(self.first_ids, key, "right"))
        return [ids for k in range(low, high) for d, _, ids in self.frame(k) if d == doc_id]


def open_shared(path: str):
    """(filesystem, path in it) of a path or URI, by pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _rename(filesystem, source: str, target: str) -> None:
    """Moves a finished shard to its name; one that another attempt of the task has left there is as good and goes."""
    from pyarrow import fs

    try:
        filesystem.move(source, target)
    except OSError:
        if filesystem.get_file_info(target).type != fs.FileType.File:
            raise
        filesystem.delete_file(target)
        filesystem.move(source, target)


def write(docs: DataFrame, path: str, vocab: str, end_id: int | None = END_ID, shards: int | None = None) -> DataFrame:
    """Writes the shards under ``path`` and returns their manifest.

    One shard for each range of doc_ids: (shard, name, n_docs, n_tokens, n_bytes),
    numbered in doc_id order.  A task writes under a name of its own attempt and
    renames, so that a repeated task leaves the same file.
    """
    spark = docs.sparkSession
    prepare(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId()
        filesystem, base = open_shared(path)
        name = f"shard-{shard:07d}.tok"
        temporary = f"{base}/.{name}.{context.taskAttemptId()}"
        enc, writer, out = encoder(vocab), None, None
        with steady():
            for batch in batches:
                for at in range(0, len(batch), 2000):
                    rows = batch.slice(at, 2000)
                    for doc_id, ids in zip(rows.column(0).to_pylist(), enc.many(rows.column(1), end_id), strict=True):
                        if writer is None:
                            out = filesystem.open_output_stream(temporary)
                            writer = Writer(out)
                        writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            n_bytes = out.tell()
            out.close()
            _rename(filesystem, temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "name": [name], "n_docs": [writer.docs], "n_tokens": [writer.total], "n_bytes": [n_bytes]},
            )

    by = ["doc_id", F.xxhash64("text").alias("_h")]  # the hash splits a doc_id that many rows have
    dealt = texts(docs).repartitionByRange(shards or partitions(spark), *by).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return materialise(dealt.mapInArrow(encode, "shard long, name string, n_docs long, n_tokens long, n_bytes long"), "token-manifest")


def read(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    The window runs over one row a shard.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("name", F.coalesce(before, F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, root = open_shared(path)
                with filesystem.open_input_file(f"{root}/{name}") as f:
                    reader = Reader(f)
                    for k in range(len(reader.entries)):
                        rows = [(d, base + s, len(t), zlib.crc32(t)) for d, s, t in reader.frame(k)]
                        doc_id, start, n, crc = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "start": start, "n_tokens": n, "ids_crc32": crc})

    spark = manifest.sparkSession
    return placed.repartition(partitions(spark)).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, writes and reads back all documents; see the module's docstring."""
    path = scratch_path(spark, "tokens")
    return read(write(table(spark, sf_dir, "documents"), path, vocabulary()), path)
