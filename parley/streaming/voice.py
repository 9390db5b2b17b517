"""Speech transcripts and the recogniser's states, in batch and as a stream.

Events: (session, seq, kind, hypotheses, error_code, granted, available); kinds: start, stop, toggle, permission,
partial, final, error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.functions.text import SPACE_CHARACTERS, is_blank

#: recogniser error codes and what is said of them (fixed values): network, no match, no speech; else the last
ERRORS = {2: "Network error during speech recognition", 7: "No speech was recognized", 6: "No speech input detected"}
OTHER_ERROR = "Speech recognition failed"


def error_text(code: Column) -> Column:
    found = F.lit(OTHER_ERROR)
    for k, v in ERRORS.items():
        found = F.when(code == k, v).otherwise(found)
    return found


def transcripts(events: DataFrame) -> DataFrame:
    """Partial and final results' first hypotheses that aren't blank, also those after a stop."""
    heard = events.where("kind in ('partial', 'final')").withColumn("text", F.try_element_at("hypotheses", F.lit(1)))
    return heard.where(~is_blank(F.col("text"))).select("session", "seq", "text")


def latest_transcript(events: DataFrame) -> DataFrame:
    return transcripts(events).groupBy("session").agg(F.max_by("text", "seq").alias("draft"))


def states(events: DataFrame) -> DataFrame:
    """The last state and its message of each session; sessions begin Idle. Works on batch input; a session's
    events are one array, bounded by what one session hears."""
    row = F.struct("seq", "kind", "error_code", "granted", "available")
    logs = events.groupBy("session").agg(F.array_sort(F.collect_list(row)).alias("log"))
    said = "case a.error_code " + " ".join(f"when {k} then '{v}'" for k, v in ERRORS.items()) + f" else '{OTHER_ERROR}' end"
    starts = "a.kind = 'start' or (a.kind = 'toggle' and s.state <> 'Listening')"
    begun = "case when not coalesce(a.available, true) then 'Unavailable' when not coalesce(a.granted, true) then s.state else 'Listening' end"
    state = lambda name, message="cast(null as string)": f"named_struct('state', {name}, 'message', {message})"
    asked = f"named_struct('state', {begun}, 'message', if({begun} = s.state, s.message, cast(null as string)))"
    step = f"""case when {starts} then {asked}
        when a.kind in ('stop', 'toggle') then if(s.state = 'Listening', {state("'Idle'")}, s)
        when a.kind = 'permission' then {state("if(a.granted, 'Listening', 'PermissionDenied')")}
        when a.kind = 'error' then {state("'Failed'", said)}
        when a.kind = 'final' then {state("'Idle'")} else s end"""
    kind = "struct<state: string, message: string>"
    fold = f"aggregate(log, cast({state(chr(39) + 'Idle' + chr(39))} as {kind}), (s, a) -> cast({step} as {kind}))"
    return logs.select("session", F.expr(fold).alias("v")).select("session", "v.state", "v.message")


OUTPUT = "session bigint, kind string, seq bigint, state string, message string, text string"


def step(state: str, message: str | None, e: dict) -> tuple[str, str | None]:
    """One event on a session's state and message; equals a step of states()."""
    kind = e["kind"]
    if kind == "start" or (kind == "toggle" and state != "Listening"):
        if e.get("available") is False:
            return "Unavailable", None if state != "Unavailable" else message
        return (state, message) if e.get("granted") is False else ("Listening", None if state != "Listening" else message)
    if kind in ("stop", "toggle"):
        return ("Idle", None) if state == "Listening" else (state, message)
    if kind == "permission":
        return ("Listening" if e.get("granted") else "PermissionDenied"), None
    if kind == "error":
        return "Failed", ERRORS.get(e.get("error_code"), OTHER_ERROR)
    return ("Idle", None) if kind == "final" else (state, message)


class Session(StatefulProcessor):
    """A session's state and message in one value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "state string, message string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = now = tuple(self.held.get()) if self.held.exists() else ("Idle", None)
        out, seq, known = [], None, self.held.exists()
        for e in sorted((e for f in rows for e in f.to_dict("records")), key=lambda e: e["seq"]):
            e |= {k: None if pd.isna(e[k]) else e[k] for k in ("granted", "available", "error_code")}
            heard, seq = e["hypotheses"], e["seq"]
            now = step(*now, e)
            first = heard[0] if e["kind"] in ("partial", "final") and heard is not None and not isinstance(heard, float) and len(heard) else None
            if first and first.strip(SPACE_CHARACTERS):
                out.append((key[0], "transcript", seq, None, None, first))
        self.held.update(now)
        if now != before or not known:
            out.append((key[0], "state", seq, *now, None))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def states_stream(events: DataFrame) -> DataFrame:
    """Rows of OUTPUT: the state of each session that a micro-batch changed or began, and the transcripts that it brought, each
    once (kinds state and transcript). Events of one batch are applied in order of seq. Sets the RocksDB state store for the session."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy("session").transformWithStateInPandas(Session(), OUTPUT, "Update", "None")
