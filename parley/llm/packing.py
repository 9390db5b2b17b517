"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are cut into pieces of at most `size` ids. A full piece is a sequence of its own. The rest
are items: each partition packs its items best-fit (longest first, each into the fullest bin
with room), gives out the bins that are nearly full, and passes the others on as items, whole, to the next
round. Rounds merge the leftovers of partitions as a tree, until one round's leftovers fit one
partition or a round no longer brings their number down.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.chunks import LIMIT, byte_tokenizer
from parley.llm.common import slices, staged, table, texts, tidy

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
BINS = "fill int, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False, limit: int = LIMIT) -> DataFrame:
    """The pieces of every text: doc_id, piece, start, length, ids_crc32, and with keep_ids the ids.

    Of a text of more than `size` ids (its end id counts) the first piece is the shorter one.
    A null text is the end id alone. Rows that repeat a doc_id are cut each for itself. limit: entries of a worker's chunk table."""
    fields = PIECES + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids = byte_tokenizer(tokenizer_path, limit).encode(part.column("text").to_pylist())
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                pieces = -(-n // size)
                first = n - (pieces - 1) * size
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.where(piece == 0, first[row], size)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
                data, ends = memoryview(ids.tobytes()), (np.cumsum(length) * 4).tolist()
                crc = [zlib.crc32(data[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                out = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in fields.split(", ")])

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(tidy(run), fields)


def best_fit(lengths: list[int], size: int) -> tuple[list[list[int]], list[int]]:
    """Bins as lists of places in lengths, and their fills: longest first, each item into the
    fullest bin with room. Bit r of `open_` is set while a bin has r places left."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_ = 0
    for i in order:
        n = lengths[i]
        fitting = open_ >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                open_ &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        room -= n
        if room:
            with_room[room].append(b)
            open_ |= 1 << room
    return bins, [sum(lengths[i] for i in b) for b in bins]


def pack_round(size: int):
    """Packs the items of a partition; reads them as they come, `at_once` to a packing."""
    at_once = 100_000

    def packed(items: list[dict]) -> pa.RecordBatch:
        bins, fills = best_fit([x["fill"] for x in items], size)
        members = [[m for i in b for m in items[i]["members"]] for b in bins]
        return pa.RecordBatch.from_arrays([pa.array(fills, pa.int32()), pa.array(members, MEMBERS)], ["fill", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[dict] = []
        for batch in batches:
            items += batch.to_pylist()
            if len(items) >= at_once:
                yield packed(items)
                items = []
        if items:
            yield packed(items)

    return run


MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def pack(pieces: DataFrame, size: int = 2048, slack: int = 2, per_partition: int = 50_000) -> DataFrame:
    """Every row of pieces (columns of PIECES) with its sequence_id and offset in that sequence.

    slack: a bin with at most so many free places counts as full. per_partition: items to a task.
    Ties and repeated rows are items like any other; an empty table gives an empty one."""
    done = []
    members = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members")
    items = pieces.select(F.col("length").cast("int").alias("fill"), members)
    items = staged(items, "pack-items")
    done.append(items.where(F.col("fill") >= size - slack))
    items = items.where(F.col("fill") < size - slack)
    n = items.count()
    while n:
        tasks = -(-n // per_partition)
        # by turns, not by a key: equal items are spread, and every task gets items of all lengths
        dealt = items.repartition(tasks)
        bins = staged(dealt.mapInArrow(tidy(pack_round(size)), BINS), "pack-bins")
        left = bins.where(F.col("fill") < size - slack)
        before, n = n, left.count()
        if tasks == 1 or n > 0.95 * before:
            done.append(bins)
            break
        done.append(bins.where(F.col("fill") >= size - slack))
        items = left
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    # bins are rows of written tables: the ids don't change when a task runs again
    placed = bins.select(F.monotonically_increasing_id().alias("sequence_id"), F.expr(
        "transform(members, (m, i) -> named_struct('m', m, 'offset', aggregate(slice(members, 1, i), 0L, (s, x) -> s + x.length)))"
    ).alias("members"))
    return placed.select("sequence_id", F.explode("members").alias("p")).select("p.m.*", "sequence_id", "p.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs."""
    return pack(cut_pieces(docs, tokenizer_path, size, end_id, limit=limit), size)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from pieces that kept their ids."""
    own = pieces.select("doc_id", "piece", "start", "ids")
    parts = placed.join(own, ["doc_id", "piece", "start"])
    gathered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return gathered.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
