"""Replaying actions into conversation state: one fold for bounded logs, the same rules for streams.

Actions: (conv_id, seq, action, text, message_id, messages). seq orders a conversation's actions. Null texts count
as empty, null messages as none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.functions.text import SPACE, SPACE_CHARACTERS
from parley.schema import EXPORT_FAILED, EXPORTED, IMPORT_FAILED, IMPORTED, IMPORTED_END

MESSAGE = "struct<id: string, author: string, text: string, is_favorite: boolean>"
ACTIONS = f"conv_id bigint, seq bigint, action string, text string, message_id string, messages array<{MESSAGE}>"
STATE = f"struct<messages: array<{MESSAGE}>, draft: string, loading: boolean, failed: boolean, favorites_only: boolean, events: array<string>>"
#: what the stream gives: rows of kind `state` (after a batch that changed it), of kind `event` (each once) and of kind `late` (an action not applied)
OUTPUT = "conv_id bigint, kind string, seq bigint, n_messages bigint, draft string, loading boolean, failed boolean, favorites_only boolean, event string"
FLAGS = "draft string, loading boolean, failed boolean, favorites_only boolean, n_messages bigint"
#: an event: the view goes to its last row
SCROLL = "scroll"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, r'\\A{SPACE}+|{SPACE}+\\z', '')"


def _state(**changed: str) -> str:
    fields = ("messages", "draft", "loading", "failed", "favorites_only", "events")
    return "named_struct(" + ", ".join(f"'{f}', {changed.get(f, f's.{f}')}" for f in fields) + ")"


def _message(author: str, text: str) -> str:
    return f"named_struct('id', concat(a.conv_id, '-', a.seq), 'author', '{author}', 'text', {text}, 'is_favorite', false)"


def _step() -> str:
    draft, brought = _trim("s.draft"), f"coalesce(a.messages, cast(array() as array<{MESSAGE}>))"
    said = lambda text: f"concat(s.events, array({text}))"
    cases = {
        "a.action in ('InputChanged', 'VoiceTranscribed')": _state(draft="coalesce(a.text, '')"),
        f"a.action = 'SendClicked' and {draft} <> '' and not s.loading": _state(messages=f"concat(s.messages, array({_message('USER', draft)}))", draft="''", loading="true", failed="false", events=said(f"'{SCROLL}'")),
        "a.action = 'ReplyReceived'": _state(messages=f"concat(s.messages, array({_message('ASSISTANT', "coalesce(a.text, '')")}))", loading="false", failed="false", events=said(f"'{SCROLL}'")),
        "a.action = 'ReplyFailed'": _state(loading="false", failed="true"),
        "a.action = 'FavoriteToggled'": _state(
            messages="transform(s.messages, m -> named_struct('id', m.id, 'author', m.author, 'text', m.text, 'is_favorite', if(m.id = a.message_id, not m.is_favorite, m.is_favorite)))"
        ),
        "a.action = 'FavoritesFilterToggled'": _state(favorites_only="not s.favorites_only"),
        "a.action = 'Exported'": _state(events=said(f"concat('{EXPORTED}', coalesce(a.text, ''))")),
        "a.action = 'ExportFailed'": _state(events=said(f"'{EXPORT_FAILED}'")),
        "a.action = 'Imported'": _state(messages=brought, events=f"concat(s.events, array(concat('{IMPORTED}', size({brought}), '{IMPORTED_END}'), '{SCROLL}'))"),
        "a.action = 'ImportFailed'": _state(events=said(f"'{IMPORT_FAILED}'")),
        "a.action = 'HistoryLoaded'": _state(messages=brought, events=said(f"'{SCROLL}'")),
    }
    return "case " + " ".join(f"when {k} then {v}" for k, v in cases.items()) + " else s end"


def replay(actions: DataFrame) -> DataFrame:
    """The last state of each conversation. ExportClicked and ImportRequested change nothing by themselves.

    A conversation's log is one array; logs are bounded by what one person does in one conversation."""
    row = F.struct("seq", "conv_id", "action", "text", "message_id", "messages")
    logs = actions.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", row.alias("a")))).alias("log"))
    start = f"cast(named_struct('messages', array(), 'draft', '', 'loading', false, 'failed', false, 'favorites_only', false, 'events', array()) as {STATE})"
    return logs.select("conv_id", F.expr(f"aggregate(log.a, {start}, (s, a) -> cast({_step()} as {STATE}))").alias("state"))


def summary(states: DataFrame) -> DataFrame:
    return states.select("conv_id", F.size("state.messages").cast("bigint").alias("n_messages"), "state.draft", "state.loading", "state.failed", "state.favorites_only", F.size("state.events").cast("bigint").alias("n_events"))


def events(states: DataFrame) -> DataFrame:
    """The events of each conversation, in order: conv_id, at (from 0), event."""
    return states.select("conv_id", F.posexplode("state.events").alias("at", "event")).withColumn("at", F.col("at").cast("bigint"))


EMPTY = {"draft": "", "loading": False, "failed": False, "favorites_only": False, "n_messages": 0}


def apply(flags: dict, a: dict) -> tuple[dict, tuple | None, list[str]]:
    """One action on a conversation's flags: the new flags, what happens to its messages (append a message, toggle an
    id, replace all by others; or None), and the events. Equals a step of replay()."""
    kind, text, brought = a["action"], a.get("text") or "", a.get("messages") or []
    said = lambda author, t: {"id": f"{a['conv_id']}-{a['seq']}", "author": author, "text": t, "is_favorite": False}
    more = {"n_messages": flags["n_messages"] + 1}
    if kind in ("InputChanged", "VoiceTranscribed"):
        return flags | {"draft": text}, None, []
    if kind == "SendClicked" and (draft := flags["draft"].strip(SPACE_CHARACTERS)) and not flags["loading"]:
        return flags | more | {"draft": "", "loading": True, "failed": False}, ("append", said("USER", draft)), [SCROLL]
    if kind == "ReplyReceived":
        return flags | more | {"loading": False, "failed": False}, ("append", said("ASSISTANT", text)), [SCROLL]
    if kind == "ReplyFailed":
        return flags | {"loading": False, "failed": True}, None, []
    if kind == "FavoriteToggled":
        return flags, ("toggle", a.get("message_id")), []
    if kind == "FavoritesFilterToggled":
        return flags | {"favorites_only": not flags["favorites_only"]}, None, []
    if kind in ("Imported", "HistoryLoaded"):
        notice = [f"{IMPORTED}{len(brought)}{IMPORTED_END}"] if kind == "Imported" else []
        return flags | {"n_messages": len(brought)}, ("replace", brought), [*notice, SCROLL]
    notices = {"Exported": EXPORTED + text, "ExportFailed": EXPORT_FAILED, "ImportFailed": IMPORT_FAILED}
    return flags, None, [notices[kind]] if kind in notices else []


def plain(rows: Iterable[pd.DataFrame]) -> list[dict]:
    """A batch's actions in order of seq, nulls as None and messages as dicts."""
    out = []
    for frame in rows:
        for a in frame.to_dict("records"):
            messages = a.get("messages")
            a["messages"] = [m.asDict() if isinstance(m, Row) else dict(m) for m in messages] if messages is not None and not isinstance(messages, float) else []
            out.append(a | {k: a[k] if isinstance(a[k], str) else None for k in ("text", "message_id")})
    return sorted(out, key=lambda a: a["seq"])


class Messages:
    """A conversation's messages in keyed state: a map by place, and of each id the places that have it, so that a toggle reads these alone."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.rows = handle.getMapState("messages", "pos bigint", "id string, author string, text string, is_favorite boolean")
        self.places = handle.getMapState("places", "id string", "at array<bigint>")

    def get(self, pos: int) -> tuple | None:
        return tuple(self.rows.getValue((pos,))) if self.rows.containsKey((pos,)) else None

    def every(self) -> Iterator[tuple[int, tuple]]:
        return ((pos[0], tuple(m)) for pos, m in self.rows.iterator())

    def of(self, message_id: str | None) -> list[int]:
        return list(self.places.getValue((message_id,))[0]) if message_id is not None and self.places.containsKey((message_id,)) else []

    def put(self, pos: int, message: dict) -> None:
        self.rows.updateValue((pos,), (message["id"], message["author"], message["text"], message["is_favorite"]))
        if message["id"] is not None:
            self.places.updateValue((message["id"],), ([*self.of(message["id"]), pos],))

    def mark(self, pos: int, is_favorite: bool) -> None:
        self.rows.updateValue((pos,), (*self.get(pos)[:3], is_favorite))

    def clear(self) -> None:
        self.rows.clear()
        self.places.clear()

    def edit(self, what: tuple | None, n: int) -> bool:
        """Does what apply() says to n messages; whether it changed one."""
        match what:
            case ("append", message):
                self.put(n, message)
            case ("toggle", wanted):
                hit = self.of(wanted)
                for pos in hit:
                    self.mark(pos, not self.get(pos)[3])
                return bool(hit)
            case ("replace", messages):
                self.clear()
                for pos, message in enumerate(messages):
                    self.put(pos, message)
            case _:
                return False
        return True


class Conversation(StatefulProcessor):
    """Flags in one value, messages in maps: a batch writes only what it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", FLAGS)
        self.mark = handle.getValueState("mark", "seq bigint")
        self.messages = Messages(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.flags.get() if self.flags.exists() else None
        before = flags = dict(zip(EMPTY, held, strict=True)) if held else EMPTY
        done = self.mark.get()[0] if self.mark.exists() else None
        changed, out, seq = False, [], done
        for a in plain(rows):
            if seq is not None and a["seq"] <= seq:
                out.append({"conv_id": key[0], "kind": "late", "seq": a["seq"], "event": a["action"]})
                continue
            n, seq = flags["n_messages"], a["seq"]
            flags, edit, said = apply(flags, a)
            changed = self.messages.edit(edit, n) or changed
            out += [{"conv_id": key[0], "kind": "event", "seq": seq, "event": x} for x in said]
        self.flags.update(tuple(flags[k] for k in EMPTY))
        self.mark.update((seq,))
        if changed or flags != before:
            out.append({"conv_id": key[0], "kind": "state", "seq": seq, **flags})
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        if out:
            yield pd.DataFrame([{n: x.get(n) for n in names} for x in out], columns=names).astype({"n_messages": "Int64", "loading": "boolean", "failed": "boolean", "favorites_only": "boolean"})

    def close(self) -> None:
        pass


def replay_stream(actions: DataFrame) -> DataFrame:
    """Rows of OUTPUT: the state of each conversation that a micro-batch changed, and the events of the batch, each once.
    Actions that come in one batch are applied in order of seq. One that comes with or after a larger seq, or once more, isn't applied but given
    out as a row of kind `late` (streaming.live holds actions back for a while to put them in order). Needs the RocksDB state store, which it sets for the session."""
    actions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return actions.groupBy("conv_id").transformWithStateInPandas(Conversation(), OUTPUT, "Update", "None")


def log_of(messages: DataFrame) -> DataFrame:
    """The action log that makes a history: a user's turn is typed and sent, an assistant's received."""
    event = lambda k, action, text: F.struct(F.lit(k).alias("k"), F.lit(action).alias("action"), text.alias("t"))
    user = F.array(event(0, "InputChanged", F.col("text")), event(1, "SendClicked", F.lit(None).cast("string")))
    reply = F.array(event(0, "ReplyReceived", F.col("text")))
    rows = messages.select("conv_id", "pos", F.explode(F.when(F.col("author") == "USER", user).otherwise(reply)).alias("e"))
    return rows.select("conv_id", (F.col("pos") * 2 + F.col("e.k")).alias("seq"), "e.action", F.col("e.t").alias("text"), F.lit(None).cast("string").alias("message_id"), F.lit(None).cast(f"array<{MESSAGE}>").alias("messages"))
