"""The reducer and the recogniser: batch fold against the one-action rules, and the streams against these."""

import random

import pytest

from parley.functions.text import SPACE_CHARACTERS
from parley.streaming import reducer, voice

MESSAGE = {"id": "m", "author": "USER", "text": "old", "is_favorite": True}
#: conv 1: guards, failure, retry, favorites; conv 2: import, notices, nulls; conv 3: history overwritten; conv 4: white space
LOG = [
    (1, 1, "InputChanged", "  hi  ", None, None), (1, 2, "SendClicked", None, None, None), (1, 3, "InputChanged", "more", None, None), (1, 4, "SendClicked", None, None, None),
    (1, 5, "ReplyFailed", None, None, None), (1, 6, "SendClicked", None, None, None), (1, 7, "ReplyReceived", "", None, None), (1, 8, "FavoriteToggled", None, "1-7", None), (1, 9, "FavoriteToggled", None, "none", None), (1, 10, "FavoritesFilterToggled", None, None, None),
    (2, 1, "Imported", None, None, [MESSAGE, MESSAGE]), (2, 2, "FavoriteToggled", None, "m", None), (2, 3, "ReplyReceived", "late", None, None), (2, 4, "ExportClicked", None, None, None), (2, 5, "Exported", "/f.json", None, None), (2, 6, "ImportFailed", None, None, None), (2, 7, "ExportFailed", None, None, None),
    (2, 8, "Imported", None, None, None), (2, 9, "Exported", None, None, None), (2, 10, "FavoriteToggled", None, None, None), (2, 11, "ReplyReceived", None, None, None),
    (3, 1, "VoiceTranscribed", " \n", None, None), (3, 2, "SendClicked", None, None, None), (3, 3, "ReplyReceived", "x", None, None), (3, 4, "HistoryLoaded", None, None, [MESSAGE]),
    (4, 1, "InputChanged", "\x85", None, None), (4, 2, "SendClicked", None, None, None), (4, 3, "InputChanged", "\xa0\u2028\x1fx\x85\u3000", None, None), (4, 4, "SendClicked", None, None, None), (4, 5, "Imported", None, None, None),
]
KINDS = ["InputChanged", "VoiceTranscribed", "SendClicked", "ReplyReceived", "ReplyFailed", "FavoriteToggled", "FavoritesFilterToggled", "ExportClicked", "Exported", "ExportFailed", "ImportRequested", "Imported", "ImportFailed", "HistoryLoaded"]


def random_log(seed, n=600):
    """n actions of six conversations."""
    draw = random.Random(seed)
    texts, ids = [None, "", "hi", " \t", "\x85", " a b\u2003", "x"], [None, "m", "n", *(f"{c}-{s}" for c in range(10, 13) for s in range(0, n, 5))]
    some = lambda: [MESSAGE | {"id": draw.choice("mno"), "is_favorite": draw.random() < 0.5} for _ in range(draw.randrange(3))]
    return [(10 + draw.randrange(6), seq, kind, draw.choice(texts), draw.choice(ids), some() if draw.random() < 0.8 else None) for seq in range(n) for kind in [draw.choice(KINDS)]]


def model(log):
    """Flags, messages and events of each conversation, one action after the other."""
    states = {}
    for c, seq, action, text, message_id, brought in log:
        flags, messages, events = states.get(c, (reducer.EMPTY, [], []))
        a = {"conv_id": c, "seq": seq, "action": action, "text": text, "message_id": message_id, "messages": brought}
        flags, edit, said = reducer.apply(flags, a)
        match edit:
            case ("append", m):
                messages = [*messages, m]
            case ("toggle", i):
                messages = [m | {"is_favorite": m["is_favorite"] != (m["id"] == i)} for m in messages]
            case ("replace", new):
                messages = list(new)
        assert flags["n_messages"] == len(messages)
        states[c] = flags, messages, [*events, *((seq, x) for x in said)]
    return states


@pytest.mark.parametrize("log", [LOG, random_log(1), random_log(2)])
def test_fold_equals_model(spark, log):
    found = {r["conv_id"]: r["state"].asDict(recursive=True) for r in reducer.replay(spark.createDataFrame(log, reducer.ACTIONS)).collect()}
    want = {c: {k: v for k, v in flags.items() if k != "n_messages"} | {"messages": messages, "events": [x for _, x in events]} for c, (flags, messages, events) in model(log).items()}
    assert found == want


def test_white_space():
    assert "x".join(SPACE_CHARACTERS) and not set("\x85\u200b\ufeff") & set(SPACE_CHARACTERS) and set(" \xa0\u1680\u2028\u2029\u202f\u205f\u3000\x1c") <= set(SPACE_CHARACTERS)
    assert [m["text"] for m in model(LOG)[1][1]] == ["hi", "more", ""] and model(LOG)[1][1][2]["is_favorite"]


def test_stream_equals_model(spark, tmp_path):
    log = LOG + random_log(3, 200)
    actions = spark.createDataFrame(log, reducer.ACTIONS)
    for part in ("seq <= 3", "seq > 3 and seq <= 70", "seq > 70"):
        actions.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last, events, batches = {}, [], []

    def keep(df, n):
        batches.append(n)
        for r in df.collect():
            if r["kind"] == "state":
                last[r["conv_id"]] = {k: r[k] for k in reducer.EMPTY}
            else:
                events.append((r["conv_id"], r["seq"], r["event"]))

    query = reducer.replay_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination(300)
    query.stop()
    want = model(log)
    assert len(batches) == 3
    assert last == {c: flags for c, (flags, _, _) in want.items()}
    assert sorted(events) == sorted((c, *e) for c, (_, _, told) in want.items() for e in told)


def random_voice(seed, n=300):
    draw = random.Random(seed)
    kinds = ["start", "stop", "toggle", "permission", "partial", "final", "error"]
    flag = lambda: draw.choice([None, True, True, False])
    heard = lambda: draw.choice([None, [], [" \u2003"], ["\x85"], ["hi", "ho"], ["x"]])
    return [(draw.randrange(8), seq, draw.choice(kinds), heard(), draw.choice([None, 2, 6, 7, 9]), flag(), flag()) for seq in range(n)]


def test_voice_stream_equals_batch(spark, tmp_path):
    schema = "session bigint, seq bigint, kind string, hypotheses array<string>, error_code int, granted boolean, available boolean"
    events = spark.createDataFrame(random_voice(1), schema)
    for part in ("seq < 100", "seq >= 100"):
        events.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last, heard = {}, []

    def keep(df, _):
        for r in df.collect():
            if r["kind"] == "state":
                last[r["session"]] = (r["state"], r["message"])
            else:
                heard.append((r["session"], r["seq"], r["text"]))

    query = voice.states_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination(300)
    query.stop()
    assert last == {r["session"]: (r["state"], r["message"]) for r in voice.states(events).collect()}
    assert sorted(heard) == sorted(map(tuple, voice.transcripts(events).collect()))
