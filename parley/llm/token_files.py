"""Token-id files in a word-aligned Simple-8b coding, written and read as Spark tables.

A 64-bit word has a selector in its top 4 bits and ids in the other 60, the first id lowest:

    selector  1   2   3   4   5   6   7   8   9  10  11  12  13  14
    ids      60  30  20  15  12  10   8   7   6   5   4   3   2   1
    bits      1   2   3   4   5   6   7   8  10  12  15  20  30  60

Selector 0 is an escape: the 60 bits count the words that follow raw, one 64-bit id each, for ids of
over 60 bits. Each word takes as many ids as fit; the last word of a block may have unused places,
which the block's count tells. A file row is one block: the rows of about `block_ids` ids, with the
number of each document's ids and the words, so that any block is decoded by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.chunks import word_tokenizer
from parley.llm.common import scratch, slices, table, texts

#: ids a word and bits an id, by selector (fixed values of the format)
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
FORMAT = "part int, block int, first_id bigint, doc_ids array<bigint>, lengths array<int>, n_ids bigint, words binary"


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each place the selector of a word that begins there: that of the most ids which fit. 0: an escape."""
    n = len(ids)
    width = np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    big = ids >= np.uint64(1 << 53)  # where doubles round: count bits exactly
    if big.any():
        width[big] = [int(x).bit_length() for x in ids[big]]
    best = np.zeros(n, np.uint8)
    step = np.concatenate([width, np.ones(64, np.uint8)])
    spans, size = {1: step}, 1  # by how many ids: the widest of so many from each place
    while size < 32:
        step = np.maximum(step[:-size], step[size:])
        size *= 2
        spans[size] = step
    for selector in range(14, 0, -1):
        count, bits = COUNTS[selector], BITS[selector]
        have = 1 << (count.bit_length() - 1)
        most = spans[have][:n]
        if have < count:
            most = np.maximum(most, spans[have][count - have : count - have + n])
        best[most <= bits] = selector
    return best


def encode(ids: np.ndarray) -> bytes:
    """The words of one block of unsigned ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    best = _selectors(ids)
    jumps = np.maximum(np.asarray(COUNTS, np.uint8)[best], 1).tolist()
    starts, at, n = [], 0, len(ids)
    while at < n:
        starts.append(at)
        at += jumps[at]
    start = np.array(starts, np.int64)
    selector = best[start]
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    words = np.zeros(len(start), np.uint64)
    for s in range(1, 15):
        own = np.flatnonzero(selector == s)
        if len(own):
            at_ = start[own]
            word = np.full(len(own), s << 60, np.uint64)
            for k in range(COUNTS[s]):
                word |= padded[at_ + k] << np.uint64(k * BITS[s])
            words[own] = word
    escaped = np.flatnonzero(selector == 0)
    if not len(escaped):
        return words.astype("<u8").tobytes()
    # a run of escapes is one escape word and its raw ids
    words[escaped] = ids[start[escaped]]
    first = escaped[np.concatenate([[True], np.diff(escaped) > 1])]
    runs = np.diff(np.concatenate([np.searchsorted(escaped, first), [len(escaped)]]))
    return np.insert(words, first, runs.astype(np.uint64)).astype("<u8").tobytes()


def decode(data: bytes, n: int) -> np.ndarray:
    """The n ids of one block: all words of a selector at once."""
    words = np.frombuffer(data, "<u8")
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    keep = np.ones(len(words), bool)
    at = 0
    if (selector == 0).any():
        zeros = np.flatnonzero(selector == 0)
        for z in zeros.tolist():
            if z >= at:
                at = z + 1 + int(words[z])
                keep[z] = False
                raw[z + 1 : at] = True
    selector[raw] = 14
    counts = np.asarray(COUNTS, np.int64)[selector]
    counts[~keep] = 0
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(1, 15):
        own = np.flatnonzero((selector == s) & keep & ~raw)
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            out[begin[own] + k] = (words[own] >> np.uint64(k * BITS[s])) & mask
    out[begin[raw]] = words[raw]
    return out[:n]


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, block_ids: int = 1 << 18) -> None:
    """Encodes each text, appends end_id, and writes blocks in ascending doc_id order under path.

    Needs doc_id (integer) and text; ignores other columns. Null text: the end id alone. Rows that
    repeat a doc_id stand next to each other, by their first 32 characters, then by hash; a null doc_id comes first. Parts are
    ranges of these, and equal rows are cut by their place in the input, so that an id of very many rows spreads over parts. An empty table gives files without blocks. Tasks write through Spark's commit:
    a lost executor's parts are written again, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = done = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[2] for h in held])
            columns = [[part], [block], [done], [[d for h in held for d in h[0]]], [np.concatenate([h[1] for h in held])], [len(ids)], [encode(ids)]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary())
            names = [f.split()[0] for f in FORMAT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for cut in slices(batch, "text", 1 << 20):
                n, ids = word_tokenizer(tokenizer_path).encode(cut.column("text").to_pylist())
                ids = np.insert(ids, np.cumsum(n), end_id)
                held.append((cut.column("doc_id").to_pylist(), n + 1, ids))
                size += len(ids)
                if size >= block_ids:
                    yield flush()
                    block, done, size = block + 1, done + size, 0
                    held.clear()
        if held:
            yield flush()

    own = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("turn"))
    ordered = own.repartitionByRange("doc_id", "head", "h", "turn").sortWithinPartitions("doc_id", "head", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(run, FORMAT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document in the files."""
    return _read(spark, path, "doc_id bigint, start bigint, ids array<bigint>", lambda ids, n: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(ids.astype(np.int64))))


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from its decoded ids."""

    def crc(ids: np.ndarray, n: np.ndarray) -> pa.Array:
        data, ends = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(n) * 4).tolist()
        return pa.array([zlib.crc32(data[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.int64())

    return _read(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", crc)


def _read(spark: SparkSession, path: str, schema: str, last) -> DataFrame:
    blocks = spark.read.schema(FORMAT).parquet(path)
    # a row for each part of the files, so as many as write tasks: few enough for one window and a broadcast
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("own"))
    before = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["lengths"], np.int64)
                ids = decode(row["words"], row["n_ids"])
                start = row["before"] + row["first_id"] + np.cumsum(n) - n
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64())]
                columns += [pa.array(n, pa.int64())] if "n_tokens" in names else []
                yield pa.RecordBatch.from_arrays([*columns, last(ids, n)], names)

    return blocks.join(F.broadcast(before), "part").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_file_digests(spark, path)
