"""Large stored histories to which imports are merged without rewriting or shuffling them.

A store is a base, a table in buckets by conversation and id, and a plain table for each import since. Reading shuffles the imports alone and joins
them to the base bucket by bucket. As id is part of the bucket, a conversation with very many messages is spread over buckets.
(A union of tables in buckets would need no shuffle at all, but Spark 4.1.2 gives wrong rows there: it takes the union as partitioned by
bucket, while a columnar union puts its tables' partitions one after the other.)

Each row has the place where its id came first and the place where its last value came from (number of the import, place in it), so
rows of an id from any tables fall together to the same row in whatever order: imports can be compacted among each other or into
the base at any time. Which tables count is told by one small file, replaced by a rename: a crash leaves the old tables or the new ones.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.sources.files import file_system

ROW = "conv_id BIGINT, id STRING, first STRUCT<n: INT, pos: BIGINT>, last STRUCT<n: INT, pos: BIGINT>, author STRING, text STRING, is_favorite BOOLEAN"
KEY = ["conv_id", "id"]
TABLES = "_tables"


def collapsed(rows: DataFrame) -> DataFrame:
    """One row for each conversation and id: the last value, the first place."""
    merged = rows.groupBy(*KEY).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max_by(F.struct("author", "text", "is_favorite"), "last").alias("m"))
    return merged.select(*KEY, "first", "last", "m.author", "m.text", "m.is_favorite")


@dataclass
class Store:
    """A store at path (a folder that all machines share) with a base in n_buckets buckets; open() gives that of an existing one."""

    spark: SparkSession
    path: str
    n_buckets: int

    @classmethod
    def create(cls, messages: DataFrame, path: str, n_buckets: int = 200) -> Store:
        """A new store with messages (conv_id, pos, id, author, text, is_favorite) as its base. Ids that repeat in a conversation fall together."""
        own = cls(messages.sparkSession, path, n_buckets)
        system, root = file_system(path)
        if system.get_file_info(f"{root}/{TABLES}").type != fs.FileType.NotFound:
            raise FileExistsError(path)
        system.create_dir(root, recursive=True)
        own._name({"base": own._base(own._rows(messages, 0).repartition(n_buckets, *KEY)), "imports": [], "next": 1, "n_buckets": n_buckets})
        return own

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        return cls(spark, path, cls(spark, path, 0)._told()["n_buckets"])

    def append(self, imported: DataFrame) -> None:
        """Adds an import: later reads have it merged. Where another writer changed the store meanwhile it is an error, and nothing is added."""
        told = self._told()
        self._name(told | {"imports": [*told["imports"], self._import(self._rows(imported, told["next"]))], "next": told["next"] + 1}, told)

    def imports(self) -> list[str]:
        """The imports' tables that the base doesn't have yet, in the order in which they were written."""
        return self._told()["imports"]

    def merged(self) -> DataFrame:
        """ROW of each conversation and id. The base isn't shuffled: the imports come to its buckets."""
        told = self._told()
        base = self._table(told["base"])
        if not told["imports"]:
            return base
        more = collapsed(self._plain(told["imports"]).repartition(self.n_buckets, *KEY))
        both = base.alias("a").join(more.alias("b"), KEY, "full_outer")
        newer = F.col("a.last").isNull() | (F.col("b.last") > F.col("a.last"))  # null without an import's row: not newer
        values = [F.when(newer, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("last", "author", "text", "is_favorite")]
        return both.select(*KEY, F.least("a.first", "b.first").alias("first"), *values)

    def history(self) -> DataFrame:
        """What operators.history.merge gives for the base and the imports, one after the other: places are counted anew."""
        pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "id")) - 1
        return self.merged().select("conv_id", pos.cast("bigint").alias("pos"), "id", "author", "text", "is_favorite")

    def compact(self, imports: list[str] | None = None) -> None:
        """Puts these imports together to one, or, without any named, all of them into a new base, which no exchange is needed for."""
        told = self._told()
        old = [told["base"], *told["imports"]] if imports is None else [t for t in told["imports"] if t in imports]
        if len(old) < 2:
            return
        if imports is None:
            fresh = told | {"base": self._base(self.merged()), "imports": []}
        else:
            fresh = told | {"imports": [self._import(collapsed(self._plain(old))), *(t for t in told["imports"] if t not in old)]}
        self._name(fresh, told)
        system, root = file_system(self.path)
        for t in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._catalog_name(t)}")
            system.delete_dir(f"{root}/{t}")

    def _rows(self, messages: DataFrame, n: int) -> DataFrame:
        """Rows of an import; those without conv_id or id have no key and are left out."""
        place = F.struct(F.lit(n).alias("n"), F.col("pos").cast("bigint").alias("pos"))
        own = messages.where("conv_id is not null and id is not null")
        return collapsed(own.select(F.col("conv_id").cast("bigint").alias("conv_id"), "id", place.alias("first"), place.alias("last"), "author", "text", "is_favorite"))

    def _import(self, rows: DataFrame) -> str:
        table = f"import-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{table}")
        return table

    def _plain(self, tables: list[str]) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(*(f"{self.path}/{t}" for t in tables))

    def _base(self, rows: DataFrame) -> str:
        """rows: each bucket in one part."""
        table = f"base-{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.n_buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{table}").saveAsTable(self._catalog_name(table))
        return table

    def _catalog_name(self, table: str) -> str:
        return f"parley_{hashlib.sha256(self.path.encode()).hexdigest()[:12]}_{table.replace('-', '_')}"

    def _table(self, table: str) -> DataFrame:
        name = self._catalog_name(table)
        if not self.spark.catalog.tableExists(name):  # written by another session
            location = f"{self.path}/{table}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({ROW}) USING parquet CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {self.n_buckets} BUCKETS LOCATION '{location}'")
        return self.spark.table(name)

    def _told(self) -> dict:
        system, root = file_system(self.path)
        with system.open_input_stream(f"{root}/{TABLES}") as f:
            return json.loads(f.read())

    def _name(self, tables: dict, seen: dict | None = None) -> None:
        """Makes these the tables that count, if what counts is still what was seen."""
        system, root = file_system(self.path)
        if seen is not None and self._told() != seen:
            raise RuntimeError(f"{self.path} was changed by another writer meanwhile")
        with system.open_output_stream(f"{root}/{TABLES}.new") as f:
            f.write(json.dumps(tables).encode())
        system.move(f"{root}/{TABLES}.new", f"{root}/{TABLES}")
