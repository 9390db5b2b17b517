"""Two tables from one stream: events and states (or view changes), each row of each batch in them once.

A micro-batch is written to folders of its own, named by its number, one under each table; then a marker with that number is
put beside them. A batch that runs again, as the query was stopped between its writes, finds a table's marker and leaves that
table alone, or finds none and overwrites the folder. Readers take the folders that have a marker: all of a batch or nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BATCH, MARKER = "batch={}", "_done-{}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.Path


def split(tables: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes the rows for which a condition (SQL) holds under its path. tables: path to condition; the rows of a batch that several
    conditions hold for go to each of these tables."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        missing = {}
        for path, condition in tables.items():
            fs, at = _file_system(spark, path)
            if not fs.exists(at(f"{path}/{MARKER.format(batch_id)}")):
                missing[path] = condition
        if not missing:
            return
        batch.persist()  # the stateful operator runs once for all tables
        try:
            for path, condition in missing.items():
                batch.where(condition).write.mode("overwrite").parquet(f"{path}/{BATCH.format(batch_id)}")
                fs, at = _file_system(spark, path)
                fs.create(at(f"{path}/{MARKER.format(batch_id)}"), True).close()
        finally:
            batch.unpersist()

    return write


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that are there as a whole."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        return []
    start = MARKER.format("")
    names = (s.getPath().getName() for s in fs.listStatus(at(path)))
    return sorted(int(n.removeprefix(start)) for n in names if n.startswith(start))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches, with their batch's number as `batch`."""
    done = batches(spark, path)
    if not done:
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(*(f"{path}/{BATCH.format(n)}" for n in done))
