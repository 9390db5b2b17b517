"""Completions with failures as data: a journal of replies by request digest.

A request is told by its payload's SHA-256, so equal payloads are asked once. Replies are appended to a table, the journal, in its order
of runs; what it has isn't asked again. A call that raises is a row with the error's text and no reply: the job goes on, and the next run
asks for these alone. A lost executor's tasks ask again, as a task's replies are stored when it ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.plans.prompt import replies

JOURNAL = "digest string, ok boolean, response string, error string, run bigint"


def digest():
    return F.sha2(F.col("payload").cast("binary"), 256)


def journal(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each digest, a reply before any failure."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], JOURNAL)
    rows = spark.read.schema(JOURNAL).parquet(path)
    best = F.max_by(F.struct("ok", "response", "error", "run"), F.struct("ok", "run"))
    return rows.groupBy("digest").agg(best.alias("r")).select("digest", "r.*")


def asked(payloads: DataFrame, client: Callable[[list[str]], list[str]], at_once: int = 1, tries: int = 1) -> DataFrame:
    """digest, ok, response and error of each row of payloads (digest, payload). client gets lists of up to at_once payloads; one that raises for
    a longer list, or returns too few, is asked for its payloads one by one, each up to `tries` times."""

    def one(payload: str) -> tuple[bool, str | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                (response,) = client([payload])
                return True, response, None
            except Exception as e:  # a failure of any kind is a row
                error = f"{type(e).__name__}: {e}"
        return False, None, error

    def some(few: list[str]) -> list[tuple[bool, str | None, str | None]]:
        if len(few) > 1:
            try:
                return [(True, response, None) for _, response in zip(few, client(few), strict=True)]
            except Exception:
                pass  # then which of them fails is found out one by one
        return [one(p) for p in few]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                cut = batch.slice(at, at_once)
                ok, response, error = zip(*some(cut.column("payload").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([cut.column("digest"), pa.array(ok), pa.array(response, pa.string()), pa.array(error, pa.string())], ["digest", "ok", "response", "error"])

    return payloads.select("digest", "payload").mapInArrow(run, "digest string, ok boolean, response string, error string")


def complete(payloads: DataFrame, client: Callable[[list[str]], list[str]], path: str, at_once: int = 1, tries: int = 1) -> DataFrame:
    """payloads (with any columns beside payload) with digest, ok, response and error, by the journal at path, to which what was missing has
    been appended. A null payload isn't asked: its row fails."""
    spark = payloads.sparkSession
    known = journal(spark, path)
    rows = payloads.withColumn("digest", digest())
    missing = rows.where("payload is not null").groupBy("digest").agg(F.first("payload").alias("payload")).join(known.where("ok").select("digest"), "digest", "left_anti")
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    asked(missing, client, at_once, tries).withColumn("run", F.lit(run).cast("bigint")).write.mode("append").parquet(path)
    out = rows.join(journal(spark, path).drop("run"), "digest", "left")
    return out.withColumns({"ok": F.coalesce("ok", F.lit(False)), "error": F.when(F.col("payload").isNull(), "no payload").otherwise(F.col("error"))})


def reply_actions(completed: DataFrame) -> DataFrame:
    """What a conversation hears of its requests (conv_id, seq, ok, response): ReplyReceived with the reply's text, or ReplyFailed, also for a response
    that can't be read; actions (conv_id, seq, action, text)."""
    key = F.struct("conv_id", "seq")
    read = replies(completed.where("ok").select(key.alias("id"), F.col("response").alias("json"))).where("ok").select("id.*", "text", F.lit(True).alias("read"))
    joined = completed.select("conv_id", "seq").join(read, ["conv_id", "seq"], "left")
    return joined.select("conv_id", "seq", F.when(F.col("read"), "ReplyReceived").otherwise("ReplyFailed").alias("action"), "text")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The journal with one row a digest, written to another path."""
    journal(spark, path).write.mode("overwrite").parquet(to)


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """digest, n_asked and the place among the runs of its first reply (null: none yet)."""
    rows = spark.read.schema(JOURNAL).parquet(path)
    in_order = rows.withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("run")))
    return in_order.groupBy("digest").agg(F.count(F.lit(1)).alias("n_asked"), F.min(F.when(F.col("ok"), F.col("nth"))).alias("replied_at"))
