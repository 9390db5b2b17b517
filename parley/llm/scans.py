"""Joins and running sums that stay even where one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import staged, with_columns

#: a key of over one in so many rows is hot, so there are no more hot keys than that
HOT_SHARE = 1000


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows with what is known of their keys (inner join; keys of known are distinct and not null). size names a column of
    known that counts the key's rows, total all rows: what is known of hot keys, 1000 of them at most, is
    broadcast, and the other rows meet it by a shuffle. rows is read twice, so it should be a written table."""
    hot = F.col(size) * HOT_SHARE > total
    more = [c for c in known.columns if c not in keys and c != size]
    few = known.where(hot).select(*keys, *more, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(few), keys, "left")
    rest = marked.where("_hot is null").drop("_hot", *more)
    return marked.where("_hot").drop("_hot").unionByName(rest.join(known.where(~hot).drop(size), keys))


def running(df: DataFrame, group: str, order: list[str], value: str, label: str, spread: list[str] = ()) -> DataFrame:
    """df with the column `running`: the sum of value (bigint, not null) over the rows of its group up to this one, by order.

    Rows are sorted by ranges of (group, order, spread), so a group of any size spreads over tasks. Each task sums its own rows; what a
    group brings from the ranges before is added from a row for each range. group: bigint, not null. spread: columns that cut ranges
    among equal rows. The result is a written table."""
    keys = [group, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried, done = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g, v = (batch.column(c).to_numpy() for c in (group, value))
            total = np.cumsum(v)
            begin = np.append(0, np.flatnonzero(g[1:] != g[:-1]) + 1)
            before = total[begin] - v[begin]
            if int(g[0]) == last:
                before[0] -= carried
            own = total - np.repeat(before, np.diff(np.append(begin, n)))
            last, carried = int(g[-1]), int(own[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n))], [*batch.schema.names, "running", "_part", "_at"])
            done += n

    ranged = df.repartitionByRange(*keys, *spread).sortWithinPartitions(*keys)
    summed = staged(ranged.mapInArrow(run, with_columns(df, "running bigint, _part int, _at bigint")), label)
    # a row for each range: its first and last group, and the sum that the last group has there
    ends = summed.groupBy("_part").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.max_by("running", "_at").alias("sum")).orderBy("_part").collect()
    carries, held, carry = [], None, 0
    for r in ends:
        if r["first"] == held:
            carries.append((r["_part"], held, carry))
        carry = r["sum"] + (carry if r["first"] == held == r["last"] else 0)
        held = r["last"]
    if not carries:
        return summed.drop("_part", "_at")
    carried = df.sparkSession.createDataFrame(carries, f"_part int, {group} bigint, _carry bigint")
    out = summed.join(F.broadcast(carried), ["_part", group], "left").withColumn("running", F.col("running") + F.coalesce("_carry", F.lit(0)))
    return out.select(*df.columns, "running")
