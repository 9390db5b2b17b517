"""Token counts with a digest cache.

A cache table has a row for each (tokenizer digest, content digest). Counting joins documents to
it by digest, encodes each distinct missing content once, appends those counts, and joins again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.chunks import word_tokenizer
from parley.llm.common import scratch, slices, staged, table, texts

CACHE = "tokenizer string, digest string, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """The digest of the tokenizer file: another file never finds this one's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, _ = word_tokenizer(path).encode(part.column("text").to_pylist(), ids=False)
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none where nothing has been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 2048, few: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty (0 tokens),
    rows that repeat, or have a null doc_id, each get a row, an empty table gives an empty one.
    cache: folder of the cache table; None takes a new one. A re-run after a failure may append a
    digest twice; reading takes one of the equal rows.

    With a filled cache digests alone are compared with it first, and up to `few` missing ones (32 bytes each) are
    broadcast to the documents: only texts that must be encoded are shuffled.
    """
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-cache")
    version = tokenizer_version(tokenizer_path)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    content = texts(docs).withColumn("digest", F.unhex(digest))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select(F.unhex("digest").alias("digest"), "n_tokens")
    filled = not known.isEmpty()
    wanted = content
    if filled:
        mine = staged(content.select("digest").distinct(), "token-digests")
        missing = staged(mine.join(known, "digest", "left_anti"), "token-misses")
        wanted = content.join(F.broadcast(missing) if missing.count() <= few else missing, "digest", "left_semi")
    # copies fall together before the shuffle
    misses = wanted.groupBy("digest").agg(F.first("text").alias("text"))
    counted = misses.mapInArrow(count_batches(tokenizer_path), "digest binary, n_tokens bigint")
    counted.select(F.lit(version).alias("tokenizer"), F.lower(F.hex("digest")).alias("digest"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).select(F.unhex("digest").alias("digest"), "n_tokens")
    if filled:  # of a large cache only what these documents need
        counts = counts.join(mine, "digest", "left_semi")
    counts = counts.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    sized = content.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    # both sides are plain scans before the join, so that a digest with many rows can be split
    return sized.join(staged(counts, "token-counts"), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
