"""Lines that many documents share, dropped by probing a sharded minimal perfect hash.

A line's key is hashed to 128 bits: the first half names its shard and its slot there, the second half is its
fingerprint. Spark counts, for each hash, the documents that hold it and the largest of their ids (combined before the
shuffle, so that a line of a third of all documents is one row a task). Hashes found in enough documents are dealt
to shards of about `shard_keys`; a task lays a shard out as a minimal perfect hash (levels of bits: a key whose place no
other key of the level takes has its bit set there, the others go on to the next level; its slot is the number of bits before its
own) and arrays by slot: fingerprint, count, largest id. Shards are rows of a table in the shared folder, some 22 bytes a
line that is found often enough; lines of fewer documents are in no shard, as they are never dropped.

Documents aren't joined with lines: a task hashes the lines of some megabytes of documents, sorts the hashes by shard,
and looks them up a shard at a time. A worker keeps the shards that it has read in a cache of bounded size. A hash of no shard gets
some slot, whose fingerprint differs (but for one chance in 2^64 a probe).
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import scratch, slices, staged, table, texts

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
COUNTED = "h1 bigint, h2 bigint, doc_id bigint"
SHARD = "shard int, n bigint, words array<int>, bits binary, fingerprints binary, counts binary, keepers binary, named binary, rest binary"
#: levels of a shard at most: what is left then (hashes whose first halves are equal) is told by both halves
LEVELS = 40


def _mixed(key: np.ndarray, level: int) -> np.ndarray:
    x = key + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(key: np.ndarray, level: int, words: int) -> np.ndarray:
    return ((_mixed(key, level) >> np.uint64(32)) * np.uint64(64 * words) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 of n distinct keys (pairs of 64-bit halves), of which only the bits are kept."""

    def __init__(self, words: list[int], bits: np.ndarray, rest: np.ndarray):
        self.words, self.bits, self.rest = words, bits, rest
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.placed = int(ones.sum())

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray, spare: float = 1.5) -> PerfectHash:
        words, levels, left = [], [], np.arange(len(first))
        for level in range(LEVELS):
            if not len(left):
                break
            n = int(len(left) * spare) // 64 + 1
            place = _place(first[left], level, n)
            alone = np.bincount(place, minlength=64 * n)[place] == 1
            level_bits = np.zeros(64 * n, np.uint8)
            level_bits[place[alone]] = 1
            words.append(n)
            levels.append(np.packbits(level_bits, bitorder="little").view("<u8"))
            left = left[~alone]
        bits = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        return cls(words, bits, np.stack([first[left], second[left]], axis=1))

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that isn't one of the n some slot, or -1."""
        out, left, start = np.full(len(first), -1, np.int64), np.arange(len(first)), 0
        for level, n in enumerate(self.words):
            place = _place(first[left], level, n)
            word, bit = self.bits[start + place // 64], (place % 64).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = self.before[start + place[hit] // 64] + below
            left, start = left[~hit], start + n
        if len(self.rest):
            told = {pair: self.placed + i for i, pair in enumerate(map(tuple, self.rest.tolist()))}
            for i in left.tolist():
                out[i] = told.get((int(first[i]), int(second[i])), -1)
        return out


class Shard:
    """What is known of a shard's lines, by slot."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(row["words"], np.frombuffer(row["bits"], "<u8"), np.frombuffer(row["rest"], "<u8").reshape(-1, 2))
        self.fingerprints, self.counts = np.frombuffer(row["fingerprints"], "<u8"), np.frombuffer(row["counts"], "<u4")
        self.keepers, self.named = np.frombuffer(row["keepers"], "<i8"), np.frombuffer(row["named"], np.uint8)
        self.size = sum(len(row[c]) for c in ("bits", "fingerprints", "counts", "keepers", "named", "rest")) + 8 * len(self.hash.before)

    @staticmethod
    def row(shard: int, first: np.ndarray, second: np.ndarray, counts: np.ndarray, keepers: pa.Array) -> dict:
        hashed = PerfectHash.build(first, second)
        slot = hashed.slots(first, second)
        by_slot = np.empty(len(slot), np.int64)
        by_slot[slot] = np.arange(len(slot))
        data = lambda x, kind: np.ascontiguousarray(x[by_slot], kind).tobytes()
        keeper, named = keepers.fill_null(0).to_numpy(zero_copy_only=False), keepers.is_valid().to_numpy(zero_copy_only=False)
        return {
            "shard": shard, "n": len(slot), "words": hashed.words, "bits": hashed.bits.astype("<u8").tobytes(), "rest": hashed.rest.astype("<u8").tobytes(),
            "fingerprints": data(second, "<u8"), "counts": data(np.minimum(counts, 2**32 - 1), "<u4"), "keepers": data(keeper, "<i8"), "named": data(named, np.uint8),
        }

    def known(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each hash: whether the shard has it, its count, the largest id, and whether there is one that isn't null."""
        if not len(self.fingerprints):
            none = np.zeros(len(first), np.int64)
            return none.astype(bool), none, none, none.astype(bool)
        slot = self.hash.slots(first, second)
        at = np.maximum(slot, 0)
        return (slot >= 0) & (self.fingerprints[at] == second), self.counts[at], self.keepers[at], self.named[at] == 1


class Shards:
    """A worker's shards, read when they are asked for; those asked for last are kept, `most` bytes of them."""

    _held: OrderedDict[tuple[str, int], Shard] = OrderedDict()

    def __init__(self, files: dict[int, str], most: int):
        self.files, self.most = files, most

    def get(self, shard: int) -> Shard | None:
        path = self.files.get(shard)
        if path is None:
            return None
        held = Shards._held
        if (path, shard) not in held:
            where, name = fs.FileSystem.from_uri("file://" + unquote(re.sub("^file:/*", "/", path)) if path.startswith("file:") else path)
            for row in pq.read_table(name, filesystem=where).to_pylist():
                held[path, row["shard"]] = Shard(row)
        held.move_to_end((path, shard))
        while len(held) > 1 and sum(s.size for s in held.values()) > self.most:
            held.popitem(last=False)
        return held[path, shard]


def _hashes(lines: list[bytes], least: int) -> tuple[list[int], bytes]:
    """Places of the lines whose keys have at least so many code points, and the hashes of these keys, 16 bytes each."""
    at, out = [], []
    for i, line in enumerate(lines):
        if len(line) >= least:
            key = line.strip(WHITE).lower()  # of bytes: A-Z alone
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                at.append(i)
                out.append(xxhash.xxh3_128_digest(key))
    return at, b"".join(out)


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                n, found = [], []
                for text in cut.column("text").cast(pa.binary()).to_pylist():
                    _, digests = _hashes(text.split(b"\n"), least)
                    own = {digests[i : i + 16] for i in range(0, len(digests), 16)}
                    n.append(len(own))
                    found.extend(own)
                first, second = _halves(b"".join(found))
                ids = cut.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), ids], ["h1", "h2", "doc_id"])

    return run


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shard, of rows sorted by shard."""
    schema = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("words", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("bits", "fingerprints", "counts", "keepers", "named", "rest"))])
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        first, second = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        row = Shard.row(rows.column("shard")[0].as_py(), first, second, rows.column("n_docs").to_numpy(), rows.column("keep_id").combine_chunks())
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        ends = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)) if len(shard) else []
        begin = 0
        for end in ends:
            if held and held[-1].column("shard")[0].as_py() != int(shard[begin]):
                yield done()
                held.clear()
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield done()


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """h1, h2 (a line key's hash), n_docs and keep_id (the largest doc_id) of keys of at least min_chars code points that at least
    min_docs rows of docs hold. Each row of docs counts as a document, with a repeated or null doc_id too; null is the smallest id."""
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(_counted(min_chars), COUNTED)
    counted = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_id"))
    return counted.where(F.col("n_docs") >= min_docs)


def index_lines(lines: DataFrame, shard_keys: int = 1 << 18) -> tuple[int, dict[int, str]]:
    """Writes shards of lines (h1, h2, n_docs, keep_id; distinct hashes) to the shared folder: their number, and the file of each
    that has lines. The driver gets a number and a file name for each `shard_keys` lines."""
    lines = staged(lines, "shared-lines")
    spark, n = lines.sparkSession, -(-lines.count() // shard_keys)
    if not n:
        return 0, {}
    path = scratch(spark, "line-shards")
    dealt = lines.withColumn("shard", F.pmod("h1", F.lit(n)).cast("int")).repartition(n, "shard").sortWithinPartitions("shard")
    dealt.mapInArrow(_laid_out, SHARD).write.parquet(path)
    return n, {r["shard"]: r["file"] for r in spark.read.schema(SHARD).parquet(path).select("shard", F.col("_metadata.file_path").alias("file")).collect()}


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, shard_keys: int = 1 << 18, cache_bytes: int = 256 << 20) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (what stays) of every row of docs.

    A text is split at line feeds (null or empty: one empty line). A line's key is the line without white space at its ends, A-Z
    lower-cased. Lines whose key has at least min_chars code points and is held by at least min_docs documents go, but for those of
    the document with the largest doc_id of these, where all of them stay. Rows that repeat that doc_id all keep them; a null doc_id
    is the smallest one. A text whose lines all go is empty. Needs doc_id (integer) and text, ignores other columns; an empty table
    gives an empty one. Texts are read whole: one of any length is one row of a task.
    """
    n_shards, files = index_lines(shared_lines(docs, min_chars, min_docs), shard_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(files, cache_bytes)
        for batch in batches:
            for cut in slices(batch, "text", 16 << 20):
                yield one(cut, shards)

    def one(cut: pa.RecordBatch, shards: Shards) -> pa.RecordBatch:
        lines = [t.split(b"\n") for t in cut.column("text").cast(pa.binary()).to_pylist()]
        places, digests = [], []
        for i, own in enumerate(lines):
            at, found = _hashes(own, min_chars)
            places.extend((i, k) for k in at)
            digests.append(found)
        first, second = _halves(b"".join(digests))
        place = np.array(places, np.int64).reshape(-1, 2)
        ids = cut.column("doc_id")
        own_id, own_named = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        goes = np.zeros(len(first), bool)
        if n_shards and len(first):
            shard = np.mod(first.view(np.int64), n_shards)
            order = np.argsort(shard, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if (held := shards.get(int(shard[some[0]]))) is None:
                    continue
                known, counts, keeper, named = held.known(first[some], second[some])
                doc = place[some, 0]
                keeps = (named == own_named[doc]) & (~named | (keeper == own_id[doc]))
                goes[some] = known & (counts >= min_docs) & ~keeps
        dropped = np.zeros(len(lines), np.int64)
        for i, k in place[goes].tolist():
            lines[i][k] = None
            dropped[i] += 1
        kept = pa.array([b"\n".join(x for x in own if x is not None) for own in lines], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids, pa.array([len(own) for own in lines], pa.int64()), pa.array(dropped), kept], ["doc_id", "n_lines", "n_dropped", "text"])

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keep_id FROM (SELECT DISTINCT key, r, doc_id FROM k WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keep_id AS goes FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256 FROM m GROUP BY r
"""
