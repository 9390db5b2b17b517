"""Distinct-chunk tables: tokenizers whose tokens never cross a chunk border see each distinct chunk once.

A table lives in a Python worker, is filled by the library itself, and is emptied when it has grown
to `limit` entries or bytes, so its memory is bounded whatever the texts are.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np


#: Entries of a table, some 200 bytes each, in every Python worker: fewer take less memory and more encoding (150,000: about
#: 12 % more over 0.1 GB).
LIMIT = 500_000


def packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class ChunkTable(dict):
    """chunk -> row; rows hold the chunk's ids. encode: list of chunks -> the packed ids of each."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = LIMIT, limit_bytes: int = 64 << 20):
        super().__init__()
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.bytes = 0
        self.ids = np.empty(0, np.uint32)
        self.length = np.empty(0, np.int64)
        self.start = np.empty(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        row = self[chunk] = len(self)
        self.fresh.append(chunk)
        return row

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The rows of chunks; they hold until the next call of room()."""
        out = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if self.fresh:
            self.bytes += sum(map(len, self.fresh))
            self.fill(self.encode(self.fresh))
            self.fresh = []
        return out

    def fill(self, encoded: list[bytes]) -> None:
        length = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(encoded), np.uint32)])
        self.length = np.concatenate([self.length, length])
        self.start = np.cumsum(self.length) - self.length

    def room(self) -> None:
        if len(self) > self.limit or self.bytes > self.limit_bytes:
            self.reset()

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of all rows, one after the other."""
        n = self.length[rows]
        ends = np.cumsum(n)
        return self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[rows] - (ends - n), n)]


#: White space for str.split() that is none for the tokenizers' pattern \s.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: A run of letters, then ASCII that no letter rule of the two files' patterns can reach back over.
_CORE = re.compile("( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-@\\[-`{-~][!-~]*)?").fullmatch
#: Byte-level files write each byte as a printable character: those that aren't come after U+00FF, in order.
_PRINTED = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordTokenizer:
    """Whole-text encoding by a `tokenizers` file that drops white space before its merges: no token,
    normal form or special string crosses white space, so words are encoded apart."""

    lower = True

    def __init__(self, path: str, limit: int = LIMIT):
        self.library = load_tokenizer(path)
        self.model = self.library.model
        self.parts: dict[str, bytes] = {}
        self.table = ChunkTable(self.encode_chunks, limit)

    def part(self, part: str, letters: bool) -> bytes:
        """The ids of a run of letters, which is one word for the model, or of what follows it."""
        if letters:
            printed = part.replace(" ", "\u0120") if part.isascii() else part.encode().decode("latin-1").translate(_PRINTED)
            ids = packed([t.id for t in self.model.tokenize(printed)])
        else:
            ids = packed(self.library.encode(part, add_special_tokens=False).ids)
        self.parts[part] = ids
        return ids

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """A new chunk such as `word.` is a run of letters and what follows: two parts, each encoded once.
        Chunks of any other kind are encoded whole."""
        if len(self.parts) > self.table.limit:
            self.parts.clear()
        known, lower, out, other = self.parts.get, self.lower, [], []
        for c in chunks:
            m = _CORE(c)
            if not m:
                other.append(len(out))
                out.append(b"")
                continue
            core, tail = m.groups()
            if lower:
                core = core.lower()
            ids = known(core) or self.part(core, True)
            out.append(ids + (known(tail) or self.part(tail, False)) if tail else ids)
        for at, e in zip(other, self.library.encode_batch_fast([chunks[i] for i in other], add_special_tokens=False), strict=True):
            out[at] = packed(e.ids)
        return out

    def split(self, text: str) -> list[str]:
        return text.split() if not _ODD_SPACE.search(text) else [text]

    def encode(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids per text and, unless not asked for, the ids of all texts."""
        self.table.room()
        split = [self.split(t) for t in texts]
        rows = self.table.rows([c for p in split for c in p])
        ends = np.concatenate([[0], np.cumsum(self.table.length[rows])])
        at = np.concatenate([[0], np.cumsum([len(p) for p in split])])
        return np.diff(ends[at]), self.table.gather(rows) if ids else np.empty(0, np.uint32)


#: A space with white space on both sides: a chunk border there could part a run of white space.
_INNER_SPACE = re.compile(r"\s \s")


class ByteTokenizer(WordTokenizer):
    """The same for byte-level files whose tokens may begin with one space: texts are cut before each
    space. Texts with a space inside a run of white space are encoded whole."""

    lower = False

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if _INNER_SPACE.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [*([first] if first else []), *[" " + x for x in rest]]


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=4)
def byte_tokenizer(path: str, limit: int = LIMIT) -> ByteTokenizer:
    return ByteTokenizer(path, limit)
