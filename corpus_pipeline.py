"""The corpus pipeline: toxicity, language, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents, whatever other columns these have. In every stage
a null text counts as an empty one and repeated rows are rows like any other, unless its docstring says more; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import exact_dedup, language_id, packing, simhash, toxicity
from parley.llm.common import staged, table, unused

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None
#: rows of marked documents that a broadcast may hold
FEW = 500_000


#: bytes that a batch of texts sent to Python may hold (a text is always whole): with less, workers and executors need less memory
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def without(docs: DataFrame, marked: DataFrame, digest: Column, label: str) -> DataFrame:
    """docs but for the rows that marked (doc_id, text_sha256, kept) has as not kept, and those it has as kept once each:
    of rows equal in id and digest the one whose other columns, written as JSON, come first, then whose text does.

    A row is told by its doc_id (null equals null) and digest, its text's SHA-256: an id may be null, or repeat
    with another text. What is marked is written first: up to FEW rows of some 60 bytes are sent to the documents, beyond
    that Spark joins by a shuffle, unless it finds them small enough itself."""
    marked = marked.withColumn("text_sha256", F.unhex("text_sha256"))
    pairs = marked.groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    pairs = staged(pairs.drop("n"), label)
    if pairs.count() <= FEW:
        pairs = F.broadcast(pairs)
    name = unused(docs, "sha256")
    keyed = docs.withColumn(name, F.unhex(digest))
    dropped, again = (pairs.where(k).select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s")) for k in ("not kept", "kept"))

    def same(rows: DataFrame, few: DataFrame) -> Column:
        return rows["doc_id"].eqNullSafe(few["i"]) & (rows[name] == few["s"])

    left = keyed.join(dropped, same(keyed, dropped), "left_anti")
    if not again.isEmpty():
        repeated = left.join(again, same(left, again), "left_semi")
        # combined before the shuffle
        order = F.struct(F.to_json(F.struct(*(c for c in docs.columns if c != "text")), {"ignoreNullFields": "false"}), "text")
        once = repeated.groupBy("doc_id", name).agg(F.min_by(F.struct(docs.columns), order).alias("row")).select("row.*")
        left = left.join(again, same(left, again), "left_anti").select(docs.columns).unionByName(once)
    return left.select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves documents scored below 0.3, with or without text or id: all of them where nothing could be learned."""
    small_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    added = unused(docs, "toxic_score"), unused(docs, "toxic_predicted")
    return toxicity.score(docs, model, added=added).where(F.col(added[1]) == 0).select(docs.columns)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves documents whose language is told with enough certainty: not null texts or those without a letter.
    Where nothing could be learned all texts with a letter are left."""
    small_batches(spark)
    added = unused(docs, "lang_pred"), unused(docs, "lang_score"), unused(docs, "lang_accepted")
    return language_id.identify(docs, language_id.learn(docs), added).where(F.col(added[2])).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the row with the largest doc_id of each set of equal texts, once: a row for each text, ids null or not."""
    copies = exact_dedup.exact_duplicates(docs).where("group_size > 1")
    return without(docs, copies, F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256), "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the row with the smallest doc_id of each near-duplicate group, once; one with a null doc_id only where no
    row of the group has an id. Fingerprints are linked, not ids, so that rows of one id are told apart by their texts."""
    small_batches(spark)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return without(docs, simhash.near_groups(docs, digest), digest, "near-copies")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their places in sequences of 2048 tokens. A document without text is its
    end id alone; rows that repeat an id are cut each for itself."""
    small_batches(spark)
    import public_tokenizers

    # smaller chunk tables than by default: the workers of earlier stages live on beside them
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
