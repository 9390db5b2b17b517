"""Imports merged into a bucketed store: without an exchange, equal to the merge of all rows, whatever was compacted when."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import history
from parley.sources.buckets import Store

SCHEMA = "conv_id bigint, pos bigint, id string, author string, text string, is_favorite boolean"


def imports(seed, n=5):
    """Histories with ids that repeat within and between them; conversation 1 has most rows."""
    draw = random.Random(seed)
    return [[(1 if draw.random() < 0.6 else draw.randrange(2, 9), p, f"i{draw.randrange(40)}", draw.choice(["USER", "ASSISTANT"]), f"{k}-{p}", draw.random() < 0.3) for p in range(60)] for k in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_compaction(spark, tmp_path, seed):
    frames = [spark.createDataFrame(r, SCHEMA) for r in imports(seed)]
    want, draw = frames[0].limit(0), random.Random(seed)
    store = Store.create(frames[0], str(tmp_path / "store"), 4)
    for k, frame in enumerate(frames):
        want = spark.createDataFrame(rows(history.merge(want, frame)), SCHEMA)
        if k:
            store.append(frame)
        assert rows(store.history()) == rows(want)
        if k > 1:
            there = store.imports()
            store.compact(draw.sample(there, min(2, len(there))) if k % 2 else None if seed == 1 else there[-1:])
            assert rows(store.history()) == rows(want)
    store.compact()
    assert store.imports() == [] and rows(store.history()) == rows(want)
    assert len(list((tmp_path / "store").iterdir())) == 2  # one table, and the file that names it


def test_no_exchange_of_what_is_stored(spark, tmp_path):
    """The base is read by bucket, also with more shuffle partitions than buckets; the imports are shuffled once."""
    store = Store.create(spark.createDataFrame(imports(3)[0], SCHEMA), str(tmp_path / "store"), 3)
    for r in imports(3)[1:]:
        store.append(spark.createDataFrame(r, SCHEMA))
    plan = store.merged()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 1 and plan.index("Bucketed: true") < plan.index("Exchange")
    store.compact()
    plan = store.merged()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # the hot conversation is in every bucket, and a bucket is a file
    base = store._told()["base"]
    assert len(list((tmp_path / "store" / base).glob("*.parquet"))) == 3
    assert len({f.name.split("_")[1] for f in (tmp_path / "store" / base).glob("*.parquet")}) == 3
    assert store.merged().where("conv_id = 1").select(F.input_file_name()).distinct().count() == 3


def test_opened_again(spark, tmp_path):
    """By a session that doesn't know the tables; a second writer that has seen an older state fails and changes nothing."""
    path = str(tmp_path / "it's a store")
    first, second, third = (spark.createDataFrame(r, SCHEMA) for r in imports(4, 3))
    Store.create(first, path, 3).append(second)
    for t in spark.catalog.listTables():
        if t.name.startswith("parley_"):
            spark.sql(f"DROP TABLE {t.name}")
    store = Store.open(spark, path)
    assert store.n_buckets == 3 and rows(store.history()) == rows(history.merge(history.merge(first.limit(0), first), second))
    seen = store._told()
    Store.open(spark, path).append(third)
    with pytest.raises(RuntimeError, match="another writer"):
        store._name(seen | {"imports": []}, seen)
    assert len(store.imports()) == 2
    with pytest.raises(FileExistsError):
        Store.create(first, path)


def test_empty_store(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    store = Store.create(none, str(tmp_path / "store"), 2)
    store.append(none)
    assert rows(store.history()) == []
    store.append(spark.createDataFrame([(1, 5, "a", "USER", "t", True), (1, 7, "a", "USER", "u", False)], SCHEMA))
    assert rows(store.history()) == [(1, 0, "a", "USER", "u", False)]
