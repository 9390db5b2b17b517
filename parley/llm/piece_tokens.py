"""SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece of a model has its white-space mark after another character, no merge crosses the
border before a marked word. Each worker then segments each distinct marked word once, through the
library, and joins the ids back by position; decoding uses the same table's decoded words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parley.llm.chunks import ChunkTable, packed
from parley.llm.common import slices, table, texts

MARK = "▁"
_WORDS = re.compile(" +[^ ]*").findall


class PieceTable(ChunkTable):
    """Also keeps each chunk's ids as decimal text and its decoded text."""

    def reset(self) -> None:
        super().reset()
        self.written: list[str] = []
        self.decoded: list[str] = []


class PieceTokenizer:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if MARK not in pieces or any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the model lacks the mark or has pieces across white space: words can't be encoded apart")
        self.mark = self.library.piece_to_id(MARK)
        self.end = self.library.eos_id()
        self.table = PieceTable(self.encode_chunks)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """A chunk begins with a space, for which the library's own first mark stands."""
        ids = self.library.encode([c[1:] for c in chunks], num_threads=1)
        ids = [[self.mark] if c == " " else x for c, x in zip(chunks, ids, strict=True)]
        self.table.written += [" ".join(map(str, x)) for x in ids]
        self.table.decoded += self.library.decode(ids, num_threads=1)
        return [packed(x) for x in ids]

    def split(self, text: str) -> list[str]:
        text = text.replace(MARK, " ")
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return _WORDS(" " + text)
        return [" " + w for w in text.split(" ")]

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all chunks, and where each text's chunks begin and end."""
        self.table.room()
        split = [self.split(t) for t in texts]
        return self.table.rows([c for p in split for c in p]), np.concatenate([[0], np.cumsum([len(p) for p in split])]).astype(np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        rows, at = self.rows(texts)
        return [[*self.table.gather(rows[a:b]).tolist(), self.end] for a, b in zip(at[:-1], at[1:], strict=True)]

    def round_trip(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: how many ids, the ids in decimal, and the text that they decode to."""
        rows, at = self.rows(texts)
        written, decoded, n = self.table.written, self.table.decoded, self.table.length
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = rows[a:b]
            each = own.tolist()
            yield int(n[own].sum()) + 1, " ".join([*[written[r] for r in each], str(self.end)]), " ".join([decoded[r] for r in each])


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (with the end id last) of every row: the operator's own output.

    A null text is an empty one: the end id alone. Repeated rows each get a row; columns besides
    doc_id and text are ignored; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = piece_tokenizer(model_path).encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text decoded from them, as for encode_pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for part in slices(batch, "text"):
                out = [(n, sha(ids), sha(text)) for n, ids, text in piece_tokenizer(model_path).round_trip(part.column("text").to_pylist())]
                n, ids, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return texts(docs).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
