"""A client that fails at times and counts its calls; ids that are never twice."""

import json

import pytest
from pyspark.sql import functions as F

from parley.functions import ids
from parley.plans import completion

SCHEMA = "conv_id bigint, seq bigint, payload string"
ROWS = [(1, 2, "a"), (1, 4, "b"), (2, 2, "a"), (2, 4, "bad"), (3, 2, None), (4, 2, "unreadable")]


def client_of(folder, failing):
    """Writes a line to a file for each payload that it is asked for."""

    def client(payloads):
        with open(f"{folder}/calls", "a") as f:
            f.writelines(f"{p}\n" for p in payloads)
        if any(p in failing for p in payloads):
            raise ConnectionError("down")
        return ["{" if p == "unreadable" else json.dumps({"choices": [{"message": {"role": "x", "content": f" re {p} "}}]}) for p in payloads]

    return client


def calls(folder):
    try:
        return sorted(open(f"{folder}/calls").read().split())
    finally:
        open(f"{folder}/calls", "w").close()


@pytest.mark.parametrize("at_once", [1, 3])
def test_only_what_is_missing_is_asked(spark, tmp_path, at_once):
    rows, path = spark.createDataFrame(ROWS, SCHEMA).coalesce(1), str(tmp_path / "journal")
    first = completion.complete(rows, client_of(tmp_path, {"bad"}), path, at_once)
    got = {(r["conv_id"], r["seq"]): (r["ok"], r["error"]) for r in first.collect()}
    assert got == {(1, 2): (True, None), (1, 4): (True, None), (2, 2): (True, None), (2, 4): (False, "ConnectionError: down"), (3, 2): (False, "no payload"), (4, 2): (True, None)}
    if at_once == 1:
        assert calls(tmp_path) == ["a", "b", "bad", "unreadable"]  # equal payloads once
    calls(tmp_path)
    actions = {(r["conv_id"], r["seq"]): (r["action"], r["text"]) for r in completion.reply_actions(first).collect()}
    assert actions == {(1, 2): ("ReplyReceived", "re a"), (1, 4): ("ReplyReceived", "re b"), (2, 2): ("ReplyReceived", "re a"), (2, 4): ("ReplyFailed", None), (3, 2): ("ReplyFailed", None), (4, 2): ("ReplyFailed", None)}
    again = completion.complete(rows.unionByName(spark.createDataFrame([(9, 2, "new")], SCHEMA)), client_of(tmp_path, set()), path, at_once)
    assert all(r["ok"] or r["payload"] is None for r in again.collect()) and calls(tmp_path) == ["bad", "new"]
    completion.complete(rows, client_of(tmp_path, set()), path).collect()
    assert calls(tmp_path) == []
    tried = {r["digest"]: (r["n_asked"], r["replied_at"]) for r in completion.attempts(spark, path).collect()}
    assert sorted(tried.values()) == [(1, 1), (1, 1), (1, 1), (1, 1), (2, 2)]
    completion.compact(spark, path, str(tmp_path / "compact"))
    assert completion.journal(spark, str(tmp_path / "compact")).where("ok").count() == 5


def test_a_client_that_fails_now_and_then(spark, tmp_path):
    """Tried again within a run; a reply too few is a failure, too."""

    def flaky(payloads):
        marks = tmp_path / f"tried-{payloads[0]}"
        if payloads[0] == "short":
            return []
        if not marks.exists():
            marks.touch()
            raise OSError("at first")
        return ["{}"] * len(payloads)

    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "short")], SCHEMA)
    got = completion.complete(rows, flaky, str(tmp_path / "journal"), tries=2).collect()
    assert sorted((r["payload"], r["ok"]) for r in got) == [("short", False), ("x", True), ("y", True)]


def test_random_ids(spark):
    """A million rows: no id twice, all bits used, the same from other partitions; another seed, other ids."""
    rows = spark.range(1_000_000).select(F.col("id") % 1000 + 2**31, F.floor(F.col("id") / 1000)).toDF("c", "p")
    made = rows.select(ids.random_id(ids.counter(F.col("c"), F.col("p"))).alias("id"))
    bits = made.agg(F.count_distinct("id").alias("n"), *(F.avg(F.shiftrightunsigned("id", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64))).first()
    assert bits["n"] == 1_000_000 and all(0.49 < bits[f"b{k}"] < 0.51 for k in range(64))
    assert made.exceptAll(rows.repartition(7).select(ids.random_id(ids.counter(F.col("c"), F.col("p"))).alias("id"))).isEmpty()
    other = rows.select(ids.random_id(ids.counter(F.col("c"), F.col("p")), seed=1).alias("id"))
    assert other.join(made, "id", "left_semi").count() < 10
    with pytest.raises(Exception, match="under 2"):
        spark.range(1).select(ids.counter(F.lit(-1), F.lit(2))).collect()
