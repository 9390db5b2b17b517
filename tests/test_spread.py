"""Folds over ranges: the replay against the fold over one array, the prefix chain against a plain loop; one hot conversation over all tasks."""

import hashlib
import json
import os
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.operators import segments
from parley.plans import prefixes, prompt
from parley.streaming import reducer, spread

sys.path.insert(0, os.path.dirname(__file__))
from test_streaming import LOG, model, random_log  # noqa: E402


@pytest.fixture
def parts(spark):
    """So many ranges, however small the data."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield 7
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def one_hot(seed):
    """A random log in which conversation 11 has most rows."""
    return [(11 if r[0] % 2 else r[0], *r[1:]) for r in random_log(seed, 900)]


@pytest.mark.parametrize("log", [LOG, random_log(4), one_hot(5), one_hot(6), one_hot(7)])
def test_spread_replay_equals_model(spark, parts, log):
    actions = spark.createDataFrame(log, reducer.ACTIONS).repartition(3)
    rows = spread.walked(actions)
    want = model(sorted(log, key=lambda r: (r[0], r[1])))
    if len(log) == 900:
        assert rows.where("conv_id = 11").select("part").distinct().count() >= 4  # spread over ranges
    flags = {r["conv_id"]: r.asDict() for r in spread.last_flags(rows).collect()}
    assert {c: {k: v for k, v in f.items() if k != "conv_id"} for c, f in flags.items()} == {c: {k: v for k, v in f.items() if k != "n_messages"} for c, (f, _, _) in want.items()}
    left = {}
    for r in sorted(spread.messages(rows).collect(), key=lambda r: (r["conv_id"], r["seq"], r["at"])):
        left.setdefault(r["conv_id"], []).append({k: r[k] for k in ("id", "author", "text", "is_favorite")})
    assert left == {c: m for c, (_, m, _) in want.items() if m}
    said = {}
    for r in sorted(spread.events(rows).collect(), key=lambda r: (r["conv_id"], r["seq"], r["at"])):
        said.setdefault(r["conv_id"], []).append((r["seq"], r["event"]))
    assert said == {c: e for c, (_, _, e) in want.items() if e}
    plain = reducer.summary(reducer.replay(actions))
    assert sorted(map(tuple, spread.summary(rows).collect())) == sorted(map(tuple, plain.collect()))


def test_spread_replay_of_nothing(spark):
    rows = spread.walked(spark.createDataFrame([(None, 1, "SendClicked", None, None, None)], reducer.ACTIONS))
    assert rows.count() == spread.summary(rows).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_summaries_join_in_any_grouping(seed):
    """Of random runs of actions, cut anywhere: the same summary, and the state that the rules lead to from any state."""
    how = spread.Replay()
    log = [dict(zip(("conv_id", "seq", "action", "text", "message_id", "messages"), r, strict=True)) for r in random_log(seed, 60)]
    run = lambda rows: pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], pa.string()) for k in ("action", "text")})
    whole = how.add(how.nothing(), run(log))
    for cut in (0, 1, 17, 59, 60):
        joined = how.join(how.add(how.nothing(), run(log[:cut])), how.join(how.nothing(), how.add(how.nothing(), run(log[cut:]))))
        assert json.loads(json.dumps(joined)) == json.loads(json.dumps(whole))
    for draft in ("", " \t", "something"):
        for loading in (False, True):
            flags = reducer.EMPTY | {"draft": draft, "loading": loading, "failed": True}
            for a in log:
                flags, _, _ = reducer.apply(flags, a)
            got = whole[0][spread.CASES.index((loading, spread._blank(draft)))]
            assert (draft if got[0] is None else got[0], got[1], True if got[2] is None else got[2], whole[1]) == (flags["draft"], flags["loading"], flags["failed"], flags["favorites_only"])


def chained(turns, system):
    """Digests of all prefixes, by a plain loop."""
    state, out = prefixes.halves(hashlib.sha256(system.encode()).hexdigest()), []
    for role, text in turns:
        h = prefixes.halves(hashlib.sha256(f"{role}\n{text}".encode()).hexdigest())
        parent = prefixes.digits(state)
        state = [(x * b + y) % prefixes.PRIME for x, b, y in zip(state, prefixes.BASES, h, strict=True)]
        out.append((prefixes.digits(state), parent))
    return out


MESSAGES = "conv_id bigint, pos bigint, id string, author string, text string, is_favorite boolean"


def test_prefix_chain(spark, parts):
    """A conversation over all ranges, copies of its beginning, an empty text."""
    rows = [(1, i, f"i{i}", "USER" if i % 2 else "ASSISTANT", f"text {i % 9}", False) for i in range(400)] + [(c, i * 3, "x", "USER" if i % 2 else "ASSISTANT", f"text {i % 9}", False) for c in (0, 5, 6) for i in range(c + 2)] + [(9, 0, "y", "USER", "", True)]
    m = spark.createDataFrame(rows, MESSAGES).repartition(3)
    links = prefixes.chain(m, "sys")
    assert links.where("conv_id = 1").select(F.spark_partition_id()).distinct().count() >= 4
    found = {(r["conv_id"], r["pos"]): (r["digest"], r["parent"], r["n_turns"]) for r in links.collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r[1], "assistant" if r[3] == "ASSISTANT" else "user", r[4]) for r in rows if r[0] == c)
        assert [found[c, p] for p, _, _ in own] == [(*d, i + 1) for i, d in enumerate(chained([t[1:] for t in own], "sys"))]
    assert sorted(r["n_convs"] for r in prefixes.shared(links).collect())[-2:] == [4, 4]  # the two turns that all but one begin with
    stored = prefixes.store(m, links)
    assert stored.count() == 401 and {(r["digest"], r["content"]) for r in stored.collect()} == {(found[r[0], r[1]][0], r[4]) for r in rows}
    asked = links.where("author = 'USER' and n_turns <= 9")
    got = asked.join(prefixes.payloads(m, links, asked, "model", "sys"), "digest").select("conv_id", "pos", "payload")
    want = prompt.requests(m, "model", "sys").join(asked.select("conv_id", "pos"), ["conv_id", "pos"], "left_semi")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("conv_id", "pos", "payload").collect()))
    assert prefixes.chain(m.limit(0), "sys").count() == 0


def test_runs_of_groups():
    """Groups over several batches and several in one; a caller that reads none, some or all of a group's rows."""
    batches = [pa.RecordBatch.from_pydict({"g": pa.array(g, pa.int64())}) for g in ([1, 1], [1, 2, 3], [], [3], [3, 4, 4])]
    assert [(k, sum(b.num_rows for b in runs)) for k, runs in segments.runs_of(iter(batches), "g")] == [(1, 3), (2, 1), (3, 3), (4, 2)]
    assert [k for k, _ in segments.runs_of(iter(batches), "g")] == [1, 2, 3, 4]
    assert [(k, next(runs).num_rows) for k, runs in segments.runs_of(iter(batches), "g")] == [(1, 2), (2, 1), (3, 1), (4, 2)]
