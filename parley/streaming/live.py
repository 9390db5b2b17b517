"""The live view of conversations: what changes on the screen, kept up from the stream of actions.

A conversation's state is its flags, counters, and messages in maps; a batch of actions gives out the view rows that came, changed or went,
the view's flags where they changed, and events. Applying the changes in order to an empty table gives what view.view_rows and
view.view_flags give for the replayed log.

Actions may come out of order and more than once. With `hold`, they wait in keyed state for so long after they were received, and
are then applied in order of seq; the seq of the last one applied is the high-water mark. One at or under the mark isn't applied:
it is given out as a row of kind `repeat` where it was applied within the last `hold`, else `late`. So state beside messages is
bounded by what comes within twice `hold`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.functions.text import SPACE_CHARACTERS
from parley.streaming import reducer

#: kinds: upsert and delete (of the view row at pos), flags, event, late and repeat (an action that wasn't applied: its name in event)
CHANGES = (
    "conv_id bigint, kind string, seq bigint, pos bigint, id string, text string, is_from_user boolean, is_speakable boolean, is_favorite boolean, can_favorite boolean, "
    "shows_spinner boolean, shows_error boolean, can_send boolean, hint string, last_index bigint, n_favorites bigint, n_messages bigint, event string"
)
NAMES = [c.split()[0] for c in CHANGES.split(", ")]
_NULLABLE = {c.split()[0]: {"bigint": "Int64", "boolean": "boolean"}[c.split()[1]] for c in CHANGES.split(", ") if not c.endswith("string")}
VIEW = ["shows_spinner", "shows_error", "can_send", "hint", "last_index", "n_favorites", "n_messages"]


def view_of(flags: dict, n_favorites: int) -> dict:
    """The flags of view.view_flags, and the counters."""
    only, loading = flags["favorites_only"], flags["loading"]
    n = n_favorites if only else flags["n_messages"]
    spins, error = loading and not only, flags["failed"] and not only
    hint = None if n or spins or error else "no_favorites" if only else "no_messages"
    can_send = bool(flags["draft"].strip(SPACE_CHARACTERS)) and not loading
    return dict(zip(VIEW, (spins, error, can_send, hint, max(n - 1, 0), n_favorites, flags["n_messages"]), strict=True))


class LiveView(StatefulProcessor):
    """hold_ms: how long actions wait to be put in order; None: they are applied as they come, each batch in order of seq."""

    def __init__(self, hold_ms: int | None = None):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flags = handle.getValueState("flags", reducer.FLAGS + ", n_favorites bigint, seq bigint")
        self.messages = reducer.Messages(handle)
        if self.hold_ms is not None:
            self.waiting = handle.getMapState("waiting", "seq bigint", "received bigint, action string, text string, message_id string, messages string")
            self.applied = handle.getMapState("applied", "seq bigint", "received bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        actions = reducer.plain(rows)
        if self.hold_ms is None:
            yield from self.given(key, self.applied_changes(key, actions))
            return
        mark, out, last = self.mark(), [], None
        for a in actions:
            received = int(pd.Timestamp(a["received"]).timestamp() * 1000)
            if self.waiting.containsKey((a["seq"],)) or self.applied.containsKey((a["seq"],)):
                out.append(self.not_applied(key, a, "repeat"))
            elif mark is not None and a["seq"] <= mark:
                out.append(self.not_applied(key, a, "late"))
            else:
                self.waiting.updateValue((a["seq"],), (received, a["action"], a["text"], a["message_id"], json.dumps(a["messages"])))
                last = received if last is None else max(last, received)
        if last is not None:
            self.handle.registerTimer(last + self.hold_ms)
        yield from self.given(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Applies what has waited for long enough, and what has a smaller seq than that; forgets what was applied long ago."""
        due = expiredTimerInfo.getExpiryTimeInMs() - self.hold_ms
        waiting = {seq[0]: tuple(a) for seq, a in self.waiting.iterator()}
        ripe = [seq for seq, a in waiting.items() if a[0] <= due]
        actions = []
        for seq in sorted(s for s in waiting if ripe and s <= max(ripe)):
            received, action, text, message_id, messages = waiting[seq]
            actions.append({"conv_id": key[0], "seq": seq, "action": action, "text": text, "message_id": message_id, "messages": json.loads(messages)})
            self.waiting.removeKey((seq,))
        for seq in [s[0] for s, a in self.applied.iterator() if a[0] < due]:
            self.applied.removeKey((seq,))
        for a in actions:
            self.applied.updateValue((a["seq"],), (max(due, waiting[a["seq"]][0]),))
        if actions:  # so that these are forgotten, too, where nothing more comes
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + 2 * self.hold_ms + 1)
        yield from self.given(key, self.applied_changes(key, actions))

    def mark(self) -> int | None:
        return self.flags.get()[-1] if self.flags.exists() else None

    def not_applied(self, key: tuple, a: dict, kind: str) -> dict:
        return {"conv_id": key[0], "kind": kind, "seq": a["seq"], "event": a["action"]}

    def applied_changes(self, key: tuple, actions: list[dict]) -> list[dict]:
        """The changes that actions, in order of seq, make to the view, each row and the flags once."""
        held = self.flags.get() if self.flags.exists() else None
        flags = dict(zip(reducer.EMPTY, held, strict=False)) if held else dict(reducer.EMPTY)
        n_favorites, mark = (held[-2], held[-1]) if held else (0, None)
        before, out = view_of(flags, n_favorites) if held else None, []
        shown: dict[int, tuple | None] = {}  # of each row that may have changed: as it was shown before

        def touch(pos: int, message: tuple | None) -> None:
            if pos not in shown:
                shown[pos] = message if message and (message[3] or not flags["favorites_only"]) else None

        for a in actions:
            if mark is not None and a["seq"] <= mark:
                out.append(self.not_applied(key, a, "late"))
                continue
            mark, n = a["seq"], flags["n_messages"]
            new, edit, said = reducer.apply(flags, a)
            match edit:
                case ("append", message):
                    touch(n, None)
                case ("toggle", wanted):
                    for pos in self.messages.of(wanted):
                        message = self.messages.get(pos)
                        touch(pos, message)
                        n_favorites += -1 if message[3] else 1
                case ("replace", brought):
                    for pos, message in self.messages.every():
                        touch(pos, message)
                    for pos in range(len(brought)):
                        touch(pos, None)
                    n_favorites = sum(m["is_favorite"] for m in brought)
            if new["favorites_only"] != flags["favorites_only"]:
                for pos, message in self.messages.every():
                    touch(pos, message)
            self.messages.edit(edit, n)
            flags = new
            out += [{"conv_id": key[0], "kind": "event", "seq": mark, "event": x} for x in said]
        if mark is not None:
            self.flags.update((*(flags[k] for k in reducer.EMPTY), n_favorites, mark))
        for pos in sorted(shown):
            message = self.messages.get(pos)
            now = message if message and (message[3] or not flags["favorites_only"]) else None
            if now != shown[pos]:
                row = {"conv_id": key[0], "kind": "delete" if now is None else "upsert", "seq": mark, "pos": pos}
                if now:
                    user = now[1] == "USER"
                    row |= {"id": now[0], "text": now[2], "is_from_user": user, "is_speakable": not user, "is_favorite": now[3], "can_favorite": not user}
                out.append(row)
        after = view_of(flags, n_favorites)
        if mark is not None and after != before:
            out.append({"conv_id": key[0], "kind": "flags", "seq": mark, **after})
        return out

    def given(self, key: tuple, out: list[dict]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(out), 10_000):
            yield pd.DataFrame([{n: x.get(n) for n in NAMES} for x in out[at : at + 10_000]], columns=NAMES).astype(_NULLABLE)

    def close(self) -> None:
        pass


def changes(actions: DataFrame, hold: timedelta | None = None) -> DataFrame:
    """CHANGES of a stream of actions (reducer.ACTIONS).

    hold: actions also have `received`, the time at which they came in (a broker's clock, say), and wait for so long. Their order in seq may
    differ from that in which they were received by up to `hold`; rows whose `received` is older than the newest one by more than `hold` are
    dropped by the engine's watermark. Needs the RocksDB state store, which it sets for the session."""
    actions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if hold is None:
        return actions.groupBy("conv_id").transformWithStateInPandas(LiveView(), CHANGES, "Update", "None")
    seconds = hold.total_seconds()
    timed = actions.withWatermark("received", f"{round(seconds * 1000)} milliseconds")
    return timed.groupBy("conv_id").transformWithStateInPandas(LiveView(round(seconds * 1000)), CHANGES, "Update", "EventTime")
