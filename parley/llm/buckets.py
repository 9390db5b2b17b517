"""Comparing rows that share a bucket, with no limit on a bucket's size and no list of all its pairs.

Buckets of over `block` rows are dealt to chunks; each pair of chunks is a task's work, so a task
never holds more than two chunks of a bucket, and every pair of a bucket meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import staged, tidy


def compare_buckets(rows: DataFrame, key: str, row_id: str, block: int, compare: Callable[[pa.RecordBatch, np.ndarray | None], Iterator[pa.RecordBatch]], schema: str, sizes: DataFrame | None = None, together: int = 0) -> DataFrame:
    """Calls compare(bucket, side) for each bucket of key (bigint), or each pair of its chunks, and returns its rows.
    sizes: count of each bucket, where it is known already. together: whole buckets of up to so many rows come many to a call,
    which has to tell them by key.

    side is None where the bucket is whole: compare all rows. Else it is 0 or 1 by row: compare rows of
    different sides, and those of side 0 among each other only where there is no side 1."""
    large = staged((rows.groupBy(key).count() if sizes is None else sizes).where(F.col("count") > block).select(key, "count"), "large-buckets")
    chunks = F.ceil(F.col("count") / block).cast("int")
    if large.isEmpty():
        dealt = rows.withColumns({"_a": F.lit(0), "_b": F.lit(0), "_side": F.lit(-1)})
    else:
        own = F.pmod(F.xxhash64(row_id), F.col("_n")).cast("int")
        both = rows.join(large.select(key, chunks.alias("_n")), key, "left")
        pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.struct(F.least(j, own).alias("a"), F.greatest(j, own).alias("b"), (j < own).cast("int").alias("side")))
        one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(-1).alias("side")))
        dealt = both.withColumn("_p", F.explode(F.when(F.col("_n").isNull(), one).otherwise(pairs)))
        dealt = dealt.select(*rows.columns, F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"), F.col("_p.side").alias("_side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(buckets(batches))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, a, b = (batch.column(c).to_numpy() for c in (key, "_a", "_b"))
            ends = np.append(np.flatnonzero((k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, batch.num_rows)
            begins = np.concatenate([[0], ends[:-1]])
            if held and (int(k[0]), int(a[0]), int(b[0])) != last:
                yield from one_bucket(held)
                held = []
            if len(ends) > 1:  # the first bucket may have begun before this batch, the last may go on after it
                yield from one_bucket([*held, batch.slice(0, ends[0])])
                held = []
                begin, n = begins[1:-1], ends[1:-1] - begins[1:-1]
                few = (n > 1) & (n <= together) & (batch.column("_side").to_numpy()[begin] < 0)
                for at in np.flatnonzero((n > 1) & ~few).tolist():
                    yield from one_bucket([batch.slice(begin[at], n[at])])
                if few.any():
                    yield from compare(batch.take(pa.array(ranges(begin[few], n[few]))), None)
            held.append(batch.slice(begins[-1]))
            last = (int(k[-1]), int(a[-1]), int(b[-1]))
        if held:
            yield from one_bucket(held)

    def one_bucket(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(p.num_rows for p in parts) < 2:
            return
        bucket = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        side = bucket.column("_side").to_numpy()
        if side[0] < 0:
            yield from compare(bucket, None)
        else:
            yield from compare(bucket, side)

    keys = [key, "_a", "_b"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0] and the n[0] - 1 numbers after it, then those from begin[1] on, and so on."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def grouped(run: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in run:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
