"""Token ids of whole texts, by the tokenizers library behind a cache of pieces.

The vocabulary's normaliser and splitter part a text into pieces (letters,
single digits, signs) that are encoded each by itself.  Texts of plain Latin
print are lower-cased and split by the same rule here, in Arrow (their normal
form is themselves); each different piece of a group of texts is looked up
once, and pieces that a worker has not kept go to the library's model, many in
one call.  Other texts are parted at blanks, across which nothing the library
does looks; their chunks that are not plain, or hold the marker of a special
token, go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lower-case letters and numbers of the Latin blocks up to U+017F (fixed values).
LETTERS, NUMBERS = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾"
#: The vocabulary's splitting rule for such texts (fixed value, read from its file's pre_tokenizer).
PIECES = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}{NUMBERS}]+")
#: The same for Arrow: what is not a run of letters gets blanks around it.
APART = f"('(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+)"
#: What is not plain Latin print, has no lower-case letter of its own, or marks a special token.
UNUSUAL = re.compile("[^\n -~¡-¬®-ſ]|İ|<\\|")
#: Longer pieces are not kept.
LONG = 100

_ENCODERS: dict[str, "Encoder"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file (never copied into this repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: printable Latin-1 itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class _Cache:
    """Two generations of a dict: what was used since the last change of generations is kept."""

    def __init__(self, keep: int):
        self.keep, self.young, self.old = keep, {}, {}

    def age(self) -> None:
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}

    def recall(self, keys: Iterable[str]) -> list[str]:
        """Moves what the old generation holds of ``keys`` to the young one and returns the rest."""
        rest = []
        for key in keys:
            if (x := self.old.get(key)) is None:
                rest.append(key)
            else:
                self.young[key] = x
        return rest


class Encoder:
    """``ids(text)``: the ids without special tokens, as a numpy array.

    ``keep`` bounds the entries of a cache's generation: memory, not results.
    """

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)  # takes pieces as they are
        self.signs = _byte_signs()
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.pieces = _Cache(keep)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)  # ids that close a piece
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        """Encodes new pieces in one call; the ids that close a piece part them."""
        signs = [p if p.isascii() else p.encode().decode("latin-1").translate(self.signs) for p in new]
        ids = np.array(self.model.encode_batch_fast([signs], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        known = self.pieces.young
        if len(cuts) == len(new) and cuts[-1] == len(ids):
            raw, width, at = ids.tobytes(), self.dtype.itemsize, 0
            for piece, cut in zip(new, (cuts * width).tolist(), strict=True):
                known[piece] = raw[at:cut]
                at = cut
        else:
            for piece in new:
                known[piece] = self._whole(piece)

    def many(self, texts: pa.Array | Iterable[str], end_id: int | None = None, group: int = 1 << 22) -> Iterator[np.ndarray]:
        """The ids of each text, and ``end_id`` after them; about ``group`` bytes of texts are taken at a time."""
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + group, "right")))
            yield from self._group(column.slice(at, to - at), end_id)
            at = to

    def _bytes(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of ``pieces``, learnt where they are new."""
        self.pieces.age()
        young = self.pieces.young
        young[""] = b""
        found = list(map(young.get, pieces))
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            unknown = self.pieces.recall([pieces[k] for k in new])
            if unknown:
                self._learn_pieces(unknown)
            for k in new:
                found[k] = young[pieces[k]] if len(pieces[k]) <= LONG else young.pop(pieces[k])
        return found

    def _odd(self, text: str) -> bytes:
        """The ids of a text that is not plain."""
        parts: list[str] = []  # a chunk that goes to the library whole is marked by a line feed
        for chunk in text.replace("\n", " ").split(" "):
            parts += ["\n" + chunk] if UNUSUAL.search(chunk) else PIECES.findall(unicodedata.normalize("NFC", chunk).lower())
        different = list(dict.fromkeys(p for p in parts if p[0] != "\n"))
        known = dict(zip(different, self._bytes(different), strict=True))
        return b"".join(self._whole(p[1:]) if p[0] == "\n" else known[p] for p in parts)

    def _group(self, column: pa.Array, end_id: int | None) -> list[np.ndarray]:
        odd = pc.match_substring_regex(column, UNUSUAL.pattern)
        plain = pc.if_else(odd, "", column) if pc.any(odd).as_py() else column
        spaced = pc.replace_substring_regex(pc.utf8_lower(plain), APART, r" \1 ")
        parted = pc.split_pattern(pc.replace_substring(spaced, "\n", " "), " ")
        coded = parted.flatten().dictionary_encode()
        found = self._bytes(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        flat, start = np.frombuffer(b"".join(found), dtype=self.dtype), np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        n = size[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) + np.repeat(start[codes] - ends[:-1], n)]
        offsets = parted.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]]
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        out = [ids[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.concatenate([np.frombuffer(self._odd(column[k].as_py()), dtype=self.dtype), out[k]])
        return out

    def ids(self, text: str) -> np.ndarray:
        return next(self.many([text]))


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
