"""Keyed operations on ordered histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import trim
from parley.schema import IMPORTED, IMPORTED_END, MESSAGE_COLUMNS


def merge(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Upsert by id within a conversation: the last value wins, the first place is kept, new ids follow in
    their order. Copies of an id within a side fall together likewise. One shuffle, combined before it."""
    both = current.select(F.lit(0).alias("side"), *MESSAGE_COLUMNS).unionByName(imported.select(F.lit(1).alias("side"), *MESSAGE_COLUMNS))
    place = F.struct("side", "pos")
    merged = both.groupBy("conv_id", "id").agg(F.min(place).alias("at"), F.max_by(F.struct("author", "text", "is_favorite"), place).alias("m"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "id")) - 1
    return merged.select("conv_id", pos.cast("bigint").alias("pos"), "id", "m.author", "m.text", "m.is_favorite")


def replace(current: DataFrame, imported: DataFrame) -> DataFrame:
    """The imported rows as they are, of conversations that are imported; the others stay."""
    others = current.join(imported.select("conv_id").distinct(), "conv_id", "left_anti")
    return others.select(MESSAGE_COLUMNS).unionByName(imported.select(MESSAGE_COLUMNS))


def append(messages: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds rows (conv_id, id, author, text, is_favorite; one for a conversation) at the end."""
    ends = messages.groupBy("conv_id").agg(F.max("pos").alias("end"))
    added = rows.join(ends, "conv_id", "left").withColumn("pos", F.coalesce(F.col("end") + 1, F.lit(0)).cast("bigint"))
    return messages.select(MESSAGE_COLUMNS).unionByName(added.select(MESSAGE_COLUMNS))


def toggle(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """Flips the mark of every row whose (conv_id, id) is in keys; other keys do nothing."""
    hit = keys.select("conv_id", "id").distinct().withColumn("_hit", F.lit(True))
    flipped = F.when(F.col("_hit"), ~F.col("is_favorite")).otherwise(F.col("is_favorite"))
    return messages.join(hit, ["conv_id", "id"], "left").withColumn("is_favorite", flipped).select(MESSAGE_COLUMNS)


def import_notice(messages: DataFrame) -> DataFrame:
    counted = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("conv_id", F.concat(F.lit(IMPORTED), F.col("n").cast("string"), F.lit(IMPORTED_END)).alias("notice"))


def sendable(drafts: DataFrame) -> DataFrame:
    """Drafts (conv_id, draft, loading) that may be sent, trimmed."""
    return drafts.withColumn("draft", trim(F.col("draft"))).where("draft <> '' and not loading").select("conv_id", "draft")
