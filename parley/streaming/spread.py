"""Replaying action logs of any length in batch: the same results as reducer.replay(), with a conversation spread over tasks.

What a run of actions does to a conversation is told by four cases: was a reply awaited before it, was the draft blank. In each case the run leaves
a draft, a loading flag and a failure flag, given or as they were, and flips the favorites filter or not. Such summaries are joined in any grouping, so ranges of the log
are summarised apart (operators.segments). Then each range is walked from the state in which it begins, by the reducer's own rules, and gives rows:

* a message when it is sent, received or brought by an import; which of them are left is told by the last import alone;
* for each id and range the number of toggles, and with a message how many of these came before it: whether a message is marked
  follows from the toggles after it, and those of ranges after its own are a row each;
* events, and the flags at the range's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import SPACE_CHARACTERS
from parley.operators.segments import checkpointed, fold
from parley.streaming import reducer

ROWS = (
    "conv_id bigint, part int, kind string, seq bigint, at bigint, id string, author string, text string, is_favorite boolean, n bigint, "
    "draft string, loading boolean, failed boolean, favorites_only boolean"
)
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ROWS.split(", ")])
#: (a reply awaited before, draft blank before)
CASES = [(loading, blank) for loading in (False, True) for blank in (False, True)]


def _blank(text: str) -> bool:
    return not text.strip(SPACE_CHARACTERS)


class Replay:
    """Summaries: for each case (draft or None as before, loading, failed or None as before), then whether the filter flips."""

    def nothing(self) -> list:
        return [[[None, loading, None] for loading, _ in CASES], False]

    def add(self, summary: list, run: pa.RecordBatch) -> list:
        states, flips = [tuple(s) for s in summary[0]], summary[1]
        for action, text in zip(run.column("action").to_pylist(), run.column("text").to_pylist(), strict=True):
            match action:
                case "InputChanged" | "VoiceTranscribed":
                    states = [(text or "", loading, failed) for _, loading, failed in states]
                case "SendClicked":
                    blank = [was if draft is None else _blank(draft) for (draft, _, _), (_, was) in zip(states, CASES, strict=True)]
                    states = [s if b or s[1] else ("", True, False) for s, b in zip(states, blank, strict=True)]
                case "ReplyReceived" | "ReplyFailed":
                    states = [(draft, False, action == "ReplyFailed") for draft, _, _ in states]
                case "FavoritesFilterToggled":
                    flips = not flips
        return [[list(s) for s in states], flips]

    def join(self, first: list, then: list) -> list:
        out = []
        for (draft, loading, failed), (_, was_blank) in zip(first[0], CASES, strict=True):
            blank = was_blank if draft is None else _blank(draft)
            next_draft, next_loading, next_failed = then[0][CASES.index((loading, blank))]
            out.append([draft if next_draft is None else next_draft, next_loading, failed if next_failed is None else next_failed])
        return [out, first[1] != then[1]]

    def walk(self, before: list, runs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        draft, loading, failed = before[0][CASES.index((False, True))]
        flags = reducer.EMPTY | {"draft": draft or "", "loading": loading, "failed": bool(failed), "favorites_only": before[1]}
        toggles: dict[str, int] = {}
        conv_id = seq = None

        def messages(kept: list[dict]) -> list[dict]:
            return [{"kind": "message", "at": i, "n": toggles.get(m["id"], 0), **m} for i, m in enumerate(kept)]

        for run in runs:
            out: list[dict] = []
            for a in run.to_pylist():
                conv_id, seq = a["conv_id"], a["seq"]
                flags, edit, said = reducer.apply(flags, a)
                rows = [{"kind": "event", "at": i, "text": x} for i, x in enumerate(said)]
                match edit:
                    case ("append", message):
                        rows += messages([message])
                    case ("toggle", wanted) if wanted is not None:
                        toggles[wanted] = toggles.get(wanted, 0) + 1
                    case ("replace", brought):
                        rows += [{"kind": "replace"}, *messages(brought)]
                out += [{"conv_id": conv_id, "part": part, "seq": seq, **r} for r in rows]
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
        flags.pop("n_messages")
        last = [{"kind": "toggles", "id": i, "n": n} for i, n in toggles.items()] + [{"kind": "flags", "seq": seq, **flags}]
        yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "part": part, **r} for r in last], _SCHEMA)


def walked(actions: DataFrame) -> DataFrame:
    """ROWS of actions (reducer.ACTIONS), as a checkpointed table. Actions without conv_id belong to no conversation and are left out."""
    rows = actions.where("conv_id is not null").select("conv_id", "seq", "action", "text", "message_id", "messages")
    return checkpointed(fold(rows, "conv_id", ["seq"], Replay(), ROWS))


def last_flags(rows: DataFrame) -> DataFrame:
    """conv_id, draft, loading, failed and favorites_only as each log leaves them."""
    names = ["draft", "loading", "failed", "favorites_only"]
    last = rows.where("kind = 'flags'").groupBy("conv_id").agg(F.max_by(F.struct(*names), "part").alias("s"))
    return last.select("conv_id", *(f"s.{n}" for n in names))


def messages(rows: DataFrame) -> DataFrame:
    """conv_id, seq, at, id, author, text and is_favorite of the messages that each log leaves; they stand in order of (seq, at)."""
    parts = rows.where("kind = 'flags'").select("conv_id", "part")
    imports = rows.where("kind = 'replace'").groupBy("conv_id").agg(F.max("seq").alias("from_seq"))
    # a row for each conversation and range, so that no key of the next join has more rows than a range
    start = parts.join(imports, "conv_id", "left").select("conv_id", "part", F.coalesce("from_seq", F.lit(-(2**63))).alias("from_seq"))
    left = rows.where("kind = 'message'").join(start, ["conv_id", "part"]).where("seq >= from_seq").drop("from_seq")
    toggles = rows.where("kind = 'toggles'").select("conv_id", "id", F.col("part").alias("in_part"), F.col("n").alias("toggles"))
    # of each message the toggles of its own range and of those after it, less those before it
    key = ["conv_id", "seq", "at"]
    hit = left.select(*key, "id", "part", "n").join(toggles, ["conv_id", "id"]).where("in_part >= part").groupBy(*key).agg((F.sum("toggles") - F.first("n")).alias("later"))
    marked = left.join(hit, key, "left").withColumn("is_favorite", F.col("is_favorite") != (F.coalesce("later", F.lit(0)) % 2 == 1))
    return marked.select(*key, "id", "author", "text", "is_favorite")


def events(rows: DataFrame) -> DataFrame:
    """conv_id, seq, at (within the action) and event."""
    return rows.where("kind = 'event'").select("conv_id", "seq", "at", F.col("text").alias("event"))


def summary(rows: DataFrame) -> DataFrame:
    """What reducer.summary() gives."""
    counted = messages(rows).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    said = events(rows).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_events"))
    joined = last_flags(rows).join(counted, "conv_id", "left").join(said, "conv_id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in ("n_messages", "n_events")}).select("conv_id", "n_messages", "draft", "loading", "failed", "favorites_only", "n_events")
