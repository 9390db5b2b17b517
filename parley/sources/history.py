"""Reading and writing histories: the conversations table, stored JSON documents, strict decoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import is_blank
from parley.schema import HISTORY, MESSAGE_COLUMNS, VERSION


DOCUMENT = "conv_id bigint, json string"


def author_of(stored: Column) -> Column:
    """Exactly ASSISTANT, else USER (also for null)."""
    return F.when(stored == "ASSISTANT", "ASSISTANT").otherwise("USER")


def from_conversations(turns: DataFrame, system: bool = False) -> DataFrame:
    """Turns as messages. Favorites are synthetic: every third assistant turn. system=True keeps system turns, as USER."""
    kept = turns if system else turns.where("role <> 'system'")
    return kept.select(
        "conv_id",
        F.col("turn").alias("pos"),
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        author_of(F.upper("role")).alias("author"),
        "text",
        ((F.col("role") == "assistant") & (F.col("turn") % 3 == 0)).alias("is_favorite"),
    )


def strictly_valid(document: Column) -> Column:
    """Whether a JSON text is one whole history: each field there with its own type, no text after it.

    Unknown keys are allowed; a missing or null field, or one of another type, is not."""
    v = F.try_parse_json(document)
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    message = lambda m: (kind(m, "$.id") == "STRING") & (kind(m, "$.author") == "STRING") & (kind(m, "$.text") == "STRING") & (kind(m, "$.isFavorite") == "BOOLEAN")
    messages = F.try_variant_get(v, "$.messages", "array<variant>")
    return F.coalesce((kind(v, "$.version") == "BIGINT") & messages.isNotNull() & F.forall(messages, lambda m: F.coalesce(message(m), F.lit(False))), F.lit(False))


def decode(documents: DataFrame, strict: bool = False) -> DataFrame:
    """Messages of documents (conv_id, json).

    Loading: a blank or undecodable document is an empty history. strict (import): it raises."""
    ok = strictly_valid(F.col("json"))
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a history: conversation "), F.col("conv_id").cast("string"))).cast("boolean"))
    good = documents.where(~is_blank(F.col("json")) | F.lit(strict)).where(ok)
    rows = good.select("conv_id", F.posexplode(F.from_json("json", HISTORY)["messages"]).alias("pos", "m"))
    return rows.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "m.id", author_of(F.col("m.author")).alias("author"), "m.text", F.col("m.isFavorite").alias("is_favorite"))


def read_history(spark: SparkSession, path: str, conv_id: int = 0, strict: bool = False) -> DataFrame:
    """One stored file; where it is absent, an empty history (strict: an error)."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)) and not strict:
        documents = spark.createDataFrame([], DOCUMENT)
    else:
        documents = spark.read.text(path, wholetext=True).select(F.lit(conv_id).cast("bigint").alias("conv_id"), F.col("value").alias("json"))
    return decode(documents, strict)


def encode(messages: DataFrame, pretty: bool = True) -> DataFrame:
    """A document (conv_id, json) for each conversation, messages in order of pos."""
    rows = F.struct("pos", F.struct("id", "author", "text", F.col("is_favorite").alias("isFavorite")).alias("m"))
    ordered = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(rows)).alias("rows"))
    document = F.struct(F.lit(VERSION).alias("version"), F.col("rows.m").alias("messages"))
    return ordered.select("conv_id", F.to_json(document, {"pretty": "true"} if pretty else {}).alias("json"))


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.Path


def _replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Writes a folder beside path and puts it in its place. What was there is renamed first and deleted last: after a crash
    at any point the old or the new folder is there, at path or (see _present) beside it."""
    fresh, old = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    write(fresh)
    fs, at = _file_system(spark, path)
    if fs.exists(at(path)):
        fs.delete(at(old), True)
        if not fs.rename(at(path), at(old)):
            raise OSError(f"couldn't move {path} to {old}")
    if not fs.rename(at(fresh), at(path)):
        raise OSError(f"couldn't move {fresh} to {path}")
    fs.delete(at(old), True)
    return path


def _present(spark: SparkSession, path: str) -> str | None:
    """path, or where a crash has left only the folder that was being replaced, that one; None where there is neither."""
    fs, at = _file_system(spark, path)
    return next((p for p in (path, path.rstrip("/") + ".old") if fs.exists(at(p))), None)


def save(messages: DataFrame, path: str) -> str:
    """Overwrites the stored documents, a Parquet table; messages may be read from path itself."""
    return _replace(messages.sparkSession, path, lambda fresh: encode(messages.select(MESSAGE_COLUMNS)).write.mode("overwrite").parquet(fresh))


def load(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The messages that save() stored; nothing where nothing was stored (strict: an error)."""
    found = _present(spark, path) or (path if strict else None)
    documents = spark.read.schema(DOCUMENT).parquet(found) if found else spark.createDataFrame([], DOCUMENT)
    return decode(documents, strict)


def export(messages: DataFrame, folder: str) -> DataFrame:
    """Writes each conversation's whole history as a text file of its own under folder, and returns conv_id and path of each.
    One file a conversation: for many of them save() is the better store."""
    spark = messages.sparkSession
    _replace(spark, folder, lambda fresh: encode(messages.select(MESSAGE_COLUMNS)).write.mode("overwrite").partitionBy("conv_id").text(fresh))
    return spark.read.text(folder, wholetext=True).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("_metadata.file_path").alias("path"))


def read_exports(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """The messages of all files that export() wrote to folder; nothing where there is none (strict: an error)."""
    found = _present(spark, folder) or (folder if strict else None)
    if not found:
        return decode(spark.createDataFrame([], DOCUMENT), strict)
    return decode(spark.read.text(found, wholetext=True).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("value").alias("json")), strict)
