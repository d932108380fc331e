"""SRC-20: files of words and vectors in the binary layout of word embeddings, read and written in parts by tasks.

A file is a line ``n dims``, then records: a word, a blank, dims little-endian 32-bit numbers, and a line feed or none.
Nothing marks a record's start, so a range of bytes finds its records by trial: from a place where ``PROBES`` records in a
row seem to stand it goes to the last one's end. A walk that began wrongly soon meets the true records (any place within a
word has the record's own end) or finds no word and is given up. Every task finds its own two ends so and walks from one to
the other. The walk of the first range begins at a true start; if it lands on its end, the second's start is true as well,
and so on: so a wrong guess cannot lose or double a row, some walk misses its end and the job fails (``split_bytes`` above
the file's size then reads it in one range).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PROBES = 16
#: Bytes of the longest word.
LONGEST = 4096
BATCH = 4096
FILE_BYTES = 64 << 20
MANIFEST = "_FILES"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files that a folder's manifest names, or of all its files where it has none."""
    system, base = _system(path)
    if system.get_file_info(base).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if system.get_file_info(base).is_file:
        found = [system.get_file_info(base)]
    elif system.get_file_info(f"{base}/{MANIFEST}").is_file:
        found = system.get_file_info([f"{base}/{name}" for name in _listed(path)])
        lost = [info.path for info in found if not info.is_file]
        if lost:
            raise FileNotFoundError(f"{path}: {len(lost)} files of the manifest are gone, {lost[0]} among them")
    else:
        found = [info for info in system.get_file_info(fs.FileSelector(base)) if info.is_file and not info.base_name.startswith(("_", "."))]
    return [(info.path, info.size) for info in sorted(found, key=lambda i: i.path)]


def _listed(path: str) -> list[str]:
    system, base = _system(path)
    if not system.get_file_info(f"{base}/{MANIFEST}").is_file:
        return []
    with system.open_input_stream(f"{base}/{MANIFEST}") as f:
        return f.read().decode().split()


def _word_end(data: bytes, at: int) -> int:
    """The place of the blank after the word at ``at``; -1 if no word stands there."""
    end = data.find(b" ", at, at + LONGEST + 1)
    return end if end > at and min(data[at:end]) > 32 else -1


def _next(data: bytes, at: int, dims: int) -> int:
    """The place after the record at ``at``; -1 if there is no whole one."""
    end = _word_end(data, at)
    if end < 0 or end + 1 + 4 * dims > len(data):
        return -1
    after = end + 1 + 4 * dims
    return after + 1 if data[after : after + 1] == b"\n" else after


def boundary(f, at: int, first: int, size: int, dims: int) -> int:
    """Where the records of a range from ``at`` on begin; the file's end if none does."""
    if at <= first:
        return first
    f.seek(at)
    data = f.read(min(size - at, (PROBES + 2) * (LONGEST + 2 + 4 * dims)))
    ends = at + len(data) == size
    for begin in range(min(len(data), LONGEST + 2 + 4 * dims)):
        place = begin
        for _ in range(PROBES):
            place = _next(data, place, dims)
            if place < 0 or (ends and place == len(data)):
                break
        if place >= 0:
            return at + place
    return size


@dataclass
class Range(InputPartition):
    path: str
    file: str
    size: int
    start: int
    end: int


class VectorReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Range]:
        step = self.split_bytes
        return [Range(self.path, file, size, a, min(a + step, size)) for file, size in _files(self.path) for a in range(0, size, step)] or [Range(self.path, "", 0, 0, 0)]

    def read(self, part: Range):
        if not part.size:
            return
        with _system(part.path)[0].open_input_file(part.file) as f:
            head = f.read(min(part.size, 64)).split(b"\n", 1)
            try:
                dims, first = int(head[0].split()[1]), len(head[0]) + 1
            except (IndexError, ValueError):
                raise ValueError(f"{part.file} does not begin with its numbers of words and dimensions") from None
            start, end = (boundary(f, at, first, part.size, dims) if at < part.size else part.size for at in (part.start, part.end))
            f.seek(start)
            data = f.read(end - start)
        words, numbers, at = [], [], 0
        while at < len(data):
            after = _next(data, at, dims)
            if after < 0:
                raise ValueError(f"{part.file}: no record at byte {start + at}; cut off, or a larger split_bytes is needed")
            blank = _word_end(data, at)
            words.append(data[at:blank].decode("utf-8", "replace"))
            numbers.append(data[blank + 1 : blank + 1 + 4 * dims])
            at = after
            if len(words) == BATCH:
                yield _batch(words, numbers, dims)
                words, numbers = [], []
        if words:
            yield _batch(words, numbers, dims)


def _batch(words: list[str], numbers: list[bytes], dims: int) -> pa.RecordBatch:
    flat = pa.array(np.frombuffer(b"".join(numbers), "<f4"))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dims), flat)
    return pa.RecordBatch.from_arrays([pa.array(words), lists], ["term", "vector"])


@dataclass
class Written(WriterCommitMessage):
    files: list


class VectorWriter(DataSourceArrowWriter):
    """Files of unique names; those of tasks that were repeated or failed are never in the manifest."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.before = _listed(path)

    def write(self, batches) -> Written:
        system, base = _system(self.path)
        system.create_dir(base, recursive=True)
        files, held, size, dims = [], [], 0, None
        for batch in batches:
            for term, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                word = (term or "").encode()
                if not word or len(word) > LONGEST or min(word) <= 32:
                    raise ValueError(f"the layout cannot hold the word {term!r}")
                values = vector.values
                if values is None or values.null_count or dims not in (None, len(values)) or not len(values):
                    raise ValueError(f"the layout cannot hold the vector of {term!r}")
                dims = len(values)
                held.append(word + b" " + values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() + b"\n")
                size += len(held[-1])
                if size >= FILE_BYTES:
                    files.append(self._save(system, base, held, dims))
                    held, size = [], 0
        if held:
            files.append(self._save(system, base, held, dims))
        return Written(files)

    @staticmethod
    def _save(system, base: str, held: list[bytes], dims: int) -> str:
        name = f"part-{uuid.uuid4().hex}.bin"
        with system.open_output_stream(f"{base}/{name}") as f:
            f.write(f"{len(held)} {dims}\n".encode())
            f.write(b"".join(held))
        return name

    def commit(self, messages) -> None:
        system, base = _system(self.path)
        system.create_dir(base, recursive=True)
        kept = [] if self.overwrite else self.before
        with system.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write("\n".join([*kept, *(name for m in messages if m for name in m.files)]).encode())
        if self.overwrite:
            self._forget(self.before)

    def abort(self, messages) -> None:
        self._forget(name for m in messages if m for name in m.files)

    def _forget(self, names) -> None:
        system, base = _system(self.path)
        for name in names:
            if system.get_file_info(f"{base}/{name}").is_file:
                system.delete_file(f"{base}/{name}")


class VectorFiles(DataSource):
    """``spark.read.format("vector_files")``: rows (term, vector); options path and split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "vector_files"

    def schema(self) -> str:
        return "term string, vector array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options["path"], int(self.options.get("split_bytes", 32 << 20)))

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(VectorFiles)
    return spark
