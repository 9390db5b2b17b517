"""Ordered folds over groups of any size: rows sorted by ranges, each range folded from what its group brings into it.

A fold that goes row by row needs a group's rows in one task. Here what some rows do to a state is a summary that can be joined with
the next rows' summary, whatever the state was: ranges are summarised at once, the driver joins a summary or two for each range, and every range is
walked from its own state. So one conversation with a third of all rows is spread over tasks like any other rows.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Fold(Protocol):
    def nothing(self) -> Any:
        """The summary of no rows."""

    def add(self, summary: Any, run: pa.RecordBatch) -> Any:
        """The summary of the rows summarised and those of run, which follow them."""

    def join(self, first: Any, then: Any) -> Any:
        """The summary of the rows of first and those of then; associative."""

    def walk(self, before: Any, runs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the rows of one group in one range give, in order, where before is the summary of the group's rows ahead of them."""


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share. Where that is unset: on one machine a folder of our own, else an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(base)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, parts as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def runs_of(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[Any, Iterator[pa.RecordBatch]]]:
    """Each group of rows sorted by group, with its rows as batches, which have to be read before the next group is."""
    held: list[tuple[Any, pa.RecordBatch]] = []

    def pieces() -> Iterator[tuple[Any, pa.RecordBatch]]:
        for batch in batches:
            values = batch.column(group)
            ends = pc.run_end_encode(values).run_ends.to_pylist() if batch.num_rows else []
            begin = 0
            for end in ends:
                yield values[begin].as_py(), batch.slice(begin, end - begin)
                begin = end

    source = pieces()

    def rest(key: Any, first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield first
        for k, run in source:
            if k != key:
                held.append((k, run))
                return
            yield run

    while True:
        key, run = held.pop() if held else next(source, (None, None))
        if run is None:
            return
        own = rest(key, run)
        yield key, own
        for _ in own:  # what the caller has left
            pass


def fold(rows: DataFrame, group: str, order: list[str], how: Fold, schema: str) -> DataFrame:
    """What how.walk gives for each group's rows (group: not null), sorted by order; ties come in any order.

    The driver gets the first and the last group of each range, and a summary for each range that a group goes on into."""
    held = checkpointed(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order))
    ends = held.groupBy(F.spark_partition_id().alias("part")).agg(F.min(group).alias("first"), F.max(group).alias("last")).orderBy("part").collect()
    crossing = {b["first"] for a, b in zip(ends, ends[1:], strict=False) if a["last"] == b["first"]}
    before: dict[int, Any] = {}  # of a range whose first group began ahead of it: the summary of these rows
    if crossing:
        wanted = pa.array(sorted(crossing))

        def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = (batch.filter(pc.is_in(batch.column(group), wanted)) for batch in batches)
            for key, runs in runs_of(some, group):
                summary = how.nothing()
                for run in runs:
                    summary = how.add(summary, run)
                yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "key": [key], "summary": [json.dumps(summary)]})

        key, so_far = None, how.nothing()
        for r in held.mapInArrow(summarise, f"part int, key {held.schema[group].dataType.simpleString()}, summary string").orderBy("part", "key").collect():
            if r["key"] == key:
                before[r["part"]] = so_far
            else:
                # a range may hold two of these groups: the second goes on into the next one
                key, so_far = r["key"], how.nothing()
            so_far = how.join(so_far, json.loads(r["summary"]))
    first_group = {r["part"]: r["first"] for r in ends}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for key, runs in runs_of(batches, group):
            yield from how.walk(before[part] if part in before and key == first_group[part] else how.nothing(), runs)

    return held.mapInArrow(walk, schema)
