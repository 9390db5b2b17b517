"""Exact dedup by a content sort, in DataFrame functions alone.

Spark samples splitters and range-partitions the rows by a sort key of the normalised text, sorts
each partition (spilling to disk where it must), and compares neighbours in full: rows of one text
stand together. Two things keep tasks even:

* The sort key is the text's first 32 characters, its hash, then the whole text. Splitters are cut on
  the first two, so that sampled keys are short and a passage which opens many texts isn't one range.
* Texts with over `hot` copies, or copies of over `hot_bytes` in all, are found beforehand by a count of hashes,
  which is combined before it is shuffled. Their copies are dealt by turns to salted ranges of about that size, each
  range is sorted and compared as any other, and the ranges' survivors meet by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import staged, table

#: Hashes of 16 bytes each that a broadcast may hold; beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null counts as empty; A-Z alone are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_duplicates(docs: DataFrame, hot: int = 1000, hot_bytes: int = 256 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs.

    keep_id is the largest doc_id among the rows of equal normalised text; kept marks its row. Needs
    doc_id and text, ignores other columns. A null text equals the empty one; a null doc_id ranks
    lowest and counts in group_size; of rows repeated with one doc_id all are marked as kept;
    an empty table gives an empty one. Texts are compared whole, however long.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("norm").cast("bigint")).alias("bytes"))
    salts = F.ceil(F.greatest(F.col("n") / hot, F.least(F.col("bytes") / hot_bytes, "n")))
    salts = staged(sizes.select("h", salts.alias("salts")).where("salts > 1"), "hot-texts")
    if salts.count() <= BROADCAST_ROWS:
        salts = F.broadcast(salts)
    # the turn is a row's place in its part of the input, so that rows which repeat an id are spread as well
    dealt = rows.withColumn("turn", F.monotonically_increasing_id()).join(salts, "h", "left").select(
        "doc_id",
        F.substring("norm", 1, 32).alias("head"),
        "h",
        F.when(F.col("salts").isNotNull(), F.pmod(F.col("turn"), F.col("salts"))).otherwise(F.lit(0)).alias("salt"),
        F.col("salts").isNotNull().alias("is_hot"),
        "norm",
    )
    ranged = dealt.repartitionByRange("head", "h", "salt").sortWithinPartitions("head", "h", "salt", "norm")
    run = Window.partitionBy("head", "h", "salt", "norm")  # met by the ranges and their order: no further exchange
    found = ranged.select(
        "doc_id",
        "is_hot",
        "salt",
        F.max("doc_id").over(run).alias("keep_id"),
        F.count(F.lit(1)).over(run).alias("group_size"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
    )
    found = staged(found, "content-sort")
    # survivors of a hot text's ranges, told by its digest; a written table, so that the join to it can be split
    hot_rows = found.where("is_hot").drop("keep_id", "group_size")
    over = staged(found.where("is_hot").groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "hot-groups")
    whole = found.where("not is_hot").unionByName(hot_rows.join(over, "text_sha256"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    return whole.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
