"""The live view against view_rows and view_flags of the batch fold, after each batch; actions out of order and twice; two tables from one stream."""

import datetime as dt
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

from parley.operators import view
from parley.streaming import live, reducer, sinks

sys.path.insert(0, os.path.dirname(__file__))
from test_streaming import LOG, random_log  # noqa: E402

ROW = ["pos", "id", "text", "is_from_user", "is_speakable", "is_favorite", "can_favorite"]
FLAGS = ["shows_spinner", "shows_error", "can_send", "hint", "last_index"]


def of_the_fold(spark, log):
    """View rows, view flags and favorites counts of the replayed log, by conversation."""
    if not log:
        return {}, {}, {}
    states = reducer.replay(spark.createDataFrame(log, reducer.ACTIONS)).select("conv_id", "state.*").cache()
    rows = states.select("conv_id", "favorites_only", F.posexplode("messages").alias("pos", "m")).select("conv_id", "favorites_only", F.col("pos").cast("bigint").alias("pos"), "m.*")
    shown = {}
    for r in view.view_rows(rows.where("is_favorite or not favorites_only")).collect():
        shown.setdefault(r["conv_id"], {})[r["pos"]] = tuple(r[c] for c in ROW)
    n = states.withColumn("n_favorites", F.size(F.filter("messages", lambda m: m["is_favorite"])))
    visible = F.when(F.col("favorites_only"), F.col("n_favorites")).otherwise(F.size("messages")).cast("bigint")
    flags = view.view_flags(n.withColumn("n_visible", visible))
    return shown, {r["conv_id"]: tuple(r[c] for c in FLAGS) for r in flags.collect()}, {r["conv_id"]: r["n_favorites"] for r in n.collect()}


class Screen:
    """What a reader of the changes holds."""

    def __init__(self):
        self.rows, self.flags, self.favorites, self.events, self.other, self.batches = {}, {}, {}, [], [], []

    def apply(self, df, n):
        self.batches.append(n)
        for r in df.collect():
            own = self.rows.setdefault(r["conv_id"], {})
            match r["kind"]:
                case "upsert":
                    assert own.get(r["pos"]) != tuple(r[c] for c in ROW)
                    own[r["pos"]] = tuple(r[c] for c in ROW)
                case "delete":
                    del own[r["pos"]]
                case "flags":
                    self.flags[r["conv_id"]], self.favorites[r["conv_id"]] = tuple(r[c] for c in FLAGS), r["n_favorites"]
                case "event":
                    self.events.append((r["conv_id"], r["seq"], r["event"]))
                case kind:
                    self.other.append((kind, r["conv_id"], r["seq"]))

    def check(self, spark, log):
        shown, flags, favorites = of_the_fold(spark, log)
        assert {c: r for c, r in self.rows.items() if r} == shown and self.flags == flags and self.favorites == favorites


def run(stream, tmp_path, keep):
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
    try:
        query.awaitTermination(300)
    finally:
        query.stop()


def test_changes_keep_the_view(spark, tmp_path):
    """After each batch: the changes so far, applied to an empty table, are the view of the log so far."""
    log = LOG + random_log(8, 240)
    cuts = [0, 3, 40, 90, 170, 10**9]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame([r for r in log if a <= r[1] < b], reducer.ACTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reducer.ACTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    screen, left = Screen(), iter(cuts[1:])

    def keep(df, n):
        screen.apply(df, n)
        end = next(left)
        screen.check(spark, [r for r in log if r[1] < end])

    run(live.changes(stream), tmp_path, keep)
    assert len(screen.batches) == 5 and not screen.other
    events = reducer.events(reducer.replay(spark.createDataFrame(log, reducer.ACTIONS)))
    assert len(screen.events) == events.count()


def test_out_of_order_and_twice(spark, tmp_path):
    """Actions shuffled within the time that they are held, every third one sent twice: the view of the ordered log. One that
    comes after its time is given out as late and not applied."""
    log, draw = random_log(9, 300), random.Random(1)
    start = dt.datetime(2024, 1, 1)
    at = lambda seconds: start + dt.timedelta(seconds=seconds)
    sent = [(r, r[1] + draw.uniform(0, 20)) for r in log]
    sent += [(r, s + draw.uniform(0, 15)) for r, s in sent if r[1] % 3 == 0]
    late = (11, 5.5, "InputChanged", "too late", None, None)
    late = (11, min(r[1] for r in log if r[0] == 11) - 1, *late[2:])
    sent.append((late, 250))
    sent.append(((99, 1, "InputChanged", "the end", None, None), 5000))
    sent.append(((99, 2, "InputChanged", "and after it", None, None), 10_000))
    schema = reducer.ACTIONS + ", received timestamp"
    for k in range(7):
        some = [(*r, at(s)) for r, s in sent if (s // 50 if s < 300 else 6 if s > 6000 else 5) == k]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    screen = Screen()
    run(live.changes(stream, dt.timedelta(seconds=40)), tmp_path, screen.apply)
    screen.check(spark, log + [(99, 1, "InputChanged", "the end", None, None)])
    assert ("late", 11, late[1]) in screen.other
    others = [x for x in screen.other if x != ("late", 11, late[1])]
    assert {k for k, _, _ in others} == {"repeat"} and len(others) == len([r for r in log if r[1] % 3 == 0])


def test_late_without_hold(spark, tmp_path):
    """As they come: what has a seq that was passed already, or came before, is given out and not applied, by both streams."""
    batches = [[(1, 5, "InputChanged", "a", None, None)], [(1, 3, "InputChanged", "b", None, None), (1, 5, "InputChanged", "c", None, None), (1, 6, "SendClicked", None, None, None), (1, 6, "ReplyReceived", "twice", None, None)]]
    for b in batches:
        spark.createDataFrame(b, reducer.ACTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(reducer.ACTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    screen, plain = Screen(), []
    run(live.changes(stream()), tmp_path / "a", screen.apply)
    assert sorted(screen.other) == [("late", 1, 3), ("late", 1, 5), ("late", 1, 6)] and [r[2] for r in screen.rows[1].values()] == ["a"]
    run(reducer.replay_stream(stream()), tmp_path / "b", lambda df, _: plain.extend(df.collect()))
    assert sorted((r["seq"], r["event"]) for r in plain if r["kind"] == "late") == [(3, "InputChanged"), (5, "InputChanged"), (6, "ReplyReceived")]
    assert [r["n_messages"] for r in plain if r["kind"] == "state"][-1] == 1


@pytest.mark.parametrize("stop_at", ["first", "second", "marker"])
def test_two_tables_each_row_once(spark, tmp_path, monkeypatch, stop_at):
    """The query ends after the first table's write, or before any marker; started again it writes what is missing and nothing twice."""
    log = random_log(12, 120)
    for part in ([r for r in log if r[1] < 60], [r for r in log if r[1] >= 60]):
        spark.createDataFrame(part, reducer.ACTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(reducer.ACTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events, states = str(tmp_path / "events"), str(tmp_path / "states")
    write = sinks.split({events: "kind = 'event'", states: "kind = 'state'"})
    real, calls = sinks._file_system, []

    def fails(spark_, path):
        calls.append(path)
        if len(calls) == {"first": 3, "second": 4, "marker": 8}[stop_at]:  # two looks for markers a batch, then one at each marker's writing
            raise RuntimeError("stopped")
        return real(spark_, path)

    monkeypatch.setattr(sinks, "_file_system", fails)
    with pytest.raises(Exception, match="stopped"):
        run(reducer.replay_stream(stream()), tmp_path, write)
    monkeypatch.setattr(sinks, "_file_system", real)
    assert len(sinks.batches(spark, events)) + len(sinks.batches(spark, states)) == {"first": 0, "second": 1, "marker": 3}[stop_at]
    run(reducer.replay_stream(stream()), tmp_path, write)
    run(reducer.replay_stream(stream()), tmp_path, write)  # nothing new
    found = sorted((r["conv_id"], r["seq"], r["event"]) for r in sinks.read(spark, events, reducer.OUTPUT).collect())
    rows = reducer.events(reducer.replay(spark.createDataFrame(log, reducer.ACTIONS))).collect()
    assert sorted((c, e) for c, _, e in found) == sorted((r["conv_id"], r["event"]) for r in rows)
    last = {}
    for r in sorted(sinks.read(spark, states, reducer.OUTPUT).collect(), key=lambda r: r["batch"]):
        last[r["conv_id"]] = r["n_messages"]
    assert last == {r["conv_id"]: r["n_messages"] for r in reducer.summary(reducer.replay(spark.createDataFrame(log, reducer.ACTIONS))).collect()}
    assert sinks.read(spark, str(tmp_path / "none"), "x int").count() == 0
