"""Queries over the conversations table and small inline inputs, with their DuckDB SQL."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import ids
from parley.operators import history, scaffold, segments, view
from parley.plans import completion, prefixes, prompt
from parley.sources import history as source
from parley.sources.buckets import Store
from parley.streaming import reducer, spread, voice

MODEL, SYSTEM = "chat-model", "You are a helpful assistant."
MESSAGES = """SELECT conv_id, turn AS pos, conv_id || '-' || turn AS id, CASE WHEN role = 'assistant' THEN 'ASSISTANT' ELSE 'USER' END AS author,
    text, role = 'assistant' AND turn % 3 = 0 AS is_favorite FROM conversations WHERE role <> 'system'"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def author_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), system=True).select("conv_id", "pos", "author")


def view_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each conversation as its log leaves it, with the favorites filter on in every second one."""
    m = messages(spark, sf_dir)
    only = F.col("conv_id") % 2 == 0
    states = m.groupBy("conv_id").agg((F.max_by("author", "pos") == "USER").alias("loading"), F.count_if("is_favorite").alias("n_fav"), F.count(F.lit(1)).alias("n"), F.max_by("text", "pos").alias("draft"))
    return view.view_flags(states.select("conv_id", "draft", "loading", F.lit(False).alias("failed"), only.alias("favorites_only"), F.when(only, F.col("n_fav")).otherwise(F.col("n")).alias("n_visible")))


VIEW_FLAGS = f"""WITH m AS ({MESSAGES}), s AS (SELECT conv_id, arg_max(author, pos) = 'USER' AS loading, count(*) FILTER (is_favorite) AS n_fav, count(*) AS n,
    arg_max(text, pos) AS draft, conv_id % 2 = 0 AS fav FROM m GROUP BY conv_id), v AS (SELECT *, CASE WHEN fav THEN n_fav ELSE n END AS nv FROM s)
SELECT conv_id, loading AND NOT fav AS shows_spinner, false AS shows_error, length(trim(draft)) > 0 AND NOT loading AS can_send,
    CASE WHEN nv = 0 AND fav THEN 'no_favorites' WHEN nv = 0 AND NOT loading THEN 'no_messages' END AS hint, greatest(nv - 1, 0) AS last_index FROM v"""


def toggle_favorite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toggles each conversation's first assistant row, and an id that isn't there."""
    m = messages(spark, sf_dir)
    keys = m.where("author = 'ASSISTANT'").groupBy("conv_id").agg(F.min_by("id", "pos").alias("id"))
    return history.toggle(m, keys.unionByName(keys.withColumn("id", F.lit("none"))))


def append_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    rows = m.select("conv_id").distinct().select("conv_id", F.concat(F.lit("new-"), F.col("conv_id").cast("string")).alias("id"), F.lit("USER").alias("author"), F.lit("thanks").alias("text"), F.lit(False).alias("is_favorite"))
    return history.append(m, rows)


def send_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    draft = F.when(F.col("turn") % 4 == 1, F.lit(" \t \n")).otherwise(F.concat(F.lit("  "), F.col("text"), F.lit(" \n")))
    return history.sendable(turns.select("conv_id", draft.alias("draft"), (F.col("turn") % 5 == 2).alias("loading")))


SPACES = r"[\t\n\x0B\f\r\x1C-\x1F\p{Z}]"
SEND_GUARD = f"""WITH d AS (SELECT conv_id, CASE WHEN turn % 4 = 1 THEN ' ' || chr(9) || chr(160) || chr(10) ELSE chr(8195) || ' ' || text || ' ' || chr(10) END AS draft, turn % 5 = 2 AS loading FROM conversations),
t AS (SELECT conv_id, regexp_replace(draft, '^{SPACES}+|{SPACES}+$', '', 'g') AS draft, loading FROM d) SELECT conv_id, draft FROM t WHERE draft <> '' AND NOT loading"""


def _sides(spark: SparkSession, sf_dir: str, copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """Turns up to 4 against turns from 2 on with changed text; copies: ids taken modulo 3, so that they repeat."""
    m = messages(spark, sf_dir)
    if copies:
        m = m.withColumn("id", F.concat_ws("-", "conv_id", F.col("pos") % 3))
    changed = m.where("pos >= 2").withColumn("text", F.concat("text", F.lit(" (edited)")))
    return m.where("pos <= 4"), changed


def _merge_sql(pick: str) -> str:
    return f"""WITH m AS (SELECT * REPLACE ({pick} AS id) FROM ({MESSAGES})),
b AS (SELECT 0 AS side, * FROM m WHERE pos <= 4 UNION ALL SELECT 1, * REPLACE (text || ' (edited)' AS text) FROM m WHERE pos >= 2),
g AS (SELECT conv_id, id, min(side * 1000000 + pos) AS place, arg_max(author, side * 1000000 + pos) AS author, arg_max(text, side * 1000000 + pos) AS text, arg_max(is_favorite, side * 1000000 + pos) AS is_favorite FROM b GROUP BY conv_id, id)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS pos, id, author, text, is_favorite FROM g"""


def history_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return history.replace(m, m.where("conv_id % 2 = 0 and pos >= 2"))


def bucketed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """history_merge by a store in buckets: a base, and the other side appended in two imports, the base compacted with the first."""
    current, imported = _sides(spark, sf_dir)
    store = Store.create(current, f"{segments.shared_folder(spark)}/store-{uuid.uuid4().hex}", 8)
    store.append(imported.where("pos % 2 = 0"))
    store.compact()
    store.append(imported.where("pos % 2 = 1"))
    return store.history()


BUCKETED_MERGE = f"""WITH b AS (SELECT 0 AS side, * FROM ({MESSAGES}) WHERE pos <= 4 UNION ALL SELECT 1 + pos % 2, * REPLACE (text || ' (edited)' AS text) FROM ({MESSAGES}) WHERE pos >= 2),
g AS (SELECT conv_id, id, min(side * 1000000 + pos) AS place, arg_max(author, side * 1000000 + pos) AS author, arg_max(text, side * 1000000 + pos) AS text, arg_max(is_favorite, side * 1000000 + pos) AS is_favorite FROM b GROUP BY conv_id, id)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS pos, id, author, text, is_favorite FROM g"""


def import_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.import_notice(history.merge(*_sides(spark, sf_dir)))


RESPONSES = [
    ("one", '{"choices": [{"message": {"role": "user", "content": " hi\\n"}, "extra": 1}]}'),
    ("two", '{"choices": [{"message": {"role": "assistant", "content": "first"}}, {"message": {"role": "assistant", "content": "second"}}], "id": "x"}'),
    ("none", '{"choices": []}'),
    ("lenient", "{choices: [{message: {role: 'assistant', content: 'ok'}}]}"),
    ("missing", "{}"),
    ("null", '{"choices": [{"message": {"role": "assistant", "content": null}}]}'),
]


def response_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.replies(spark.createDataFrame(RESPONSES, "id string, json string"))


def _values(rows: list[tuple], names: str) -> str:
    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, (bool, int)):
            return str(x).lower()
        return "[" + ", ".join(map(literal, x)) + "]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"


DOCUMENTS = [
    (1, json.dumps({"version": 1, "messages": [{"id": f"mock-{i}", "author": a, "text": f"text {i}", "isFavorite": i % 2 == 0} for i, a in enumerate(["USER", "ASSISTANT", "USER", "ASSISTANT"], 1)]})),
    (2, "  \n"),
    (3, '{"version": 1, "messages": [{"id": "a"'),
    (4, '{"version": 1, "messages": [{"id": "a", "author": "USER", "text": "t"}]}'),
    (5, '{"version": 1, "messages": [{"id": "a", "author": null, "text": "t", "isFavorite": true}]}'),
    (6, '{"version": 2, "more": {}, "messages": [{"id": "a", "author": "assistant", "text": "t", "isFavorite": true, "x": 1}, {"id": "b", "author": "SYSTEM", "text": "", "isFavorite": false}]}'),
    (7, '{"version": 1, "messages": []} {}'),
]


def history_strict_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.decode(spark.createDataFrame(DOCUMENTS, "conv_id bigint, json string"))


STRICT = f"SELECT * FROM {_values([(1, i - 1, f'mock-{i}', 'USER' if i % 2 else 'ASSISTANT', f'text {i}', i % 2 == 0) for i in range(1, 5)] + [(6, 0, 'a', 'USER', 't', True), (6, 1, 'b', 'USER', '', False)], 'conv_id, pos, id, author, text, is_favorite')}"


def history_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every history and decodes it again; places count from 0."""
    return source.decode(source.encode(messages(spark, sf_dir)), strict=True)


ROUNDTRIP = f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS pos, id, author, text, is_favorite FROM ({MESSAGES})"


OLD = [("old-1", "USER", "before", True), ("old-2", "ASSISTANT", "then", False)]


def all_actions(m: DataFrame) -> DataFrame:
    """The log of each history with every other kind of action around it: histories are loaded or imported first; then, by
    conversation, failures, notices, toggles and a transcript follow."""
    brought = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("id", "author", "text", "is_favorite"), row, strict=True))) for row in OLD))
    none = F.lit(None).cast("string")
    before = [("HistoryLoaded", none, none, F.slice(brought, 1, 1)), ("ImportRequested", F.lit("{}"), none, None), ("Imported", none, none, brought)]
    after = [
        ("ReplyFailed", none, none, None), ("FavoritesFilterToggled", none, none, None), ("FavoriteToggled", none, F.lit("old-2"), None), ("FavoriteToggled", none, F.lit("none"), None), ("ExportClicked", none, none, None),
        ("Exported", F.lit("/x.json"), none, None), ("ExportFailed", none, none, None), ("ImportFailed", none, none, None), ("VoiceTranscribed", F.lit(" said \u0085"), none, None),
    ]
    some = lambda i, row: F.struct((F.lit(i).cast("bigint")).alias("seq"), F.lit(row[0]).alias("action"), row[1].alias("text"), row[2].alias("message_id"), (F.lit(None) if row[3] is None else row[3]).cast(f"array<{reducer.MESSAGE}>").alias("messages"))
    conversations = m.select("conv_id").distinct()
    first = conversations.select("conv_id", F.explode(F.array(*(some(i - 10, r) for i, r in enumerate(before)))).alias("e"))
    last = conversations.where("conv_id % 2 = 0").select("conv_id", F.explode(F.array(*(some(10**6 + i, r) for i, r in enumerate(after)))).alias("e"))
    return reducer.log_of(m).unionByName(first.unionByName(last).select("conv_id", "e.*"))


def reducer_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final states, with the number and text of all messages and events."""
    states = reducer.replay(all_actions(messages(spark, sf_dir)))
    marked = F.array_join(F.transform(F.filter("state.messages", lambda x: x["is_favorite"]), lambda x: x["id"]), ",")
    more = states.select("conv_id", marked.alias("favorites"), F.array_join("state.events", "|").alias("events"), F.array_join("state.messages.text", "|").alias("texts"))
    return reducer.summary(states).join(more, "conv_id")


REPLAY = f"""WITH s AS (SELECT conv_id, conv_id % 2 = 0 AS more, count(*) AS n, arg_max(author, pos) = 'USER' AS waiting, string_agg(regexp_replace(text, '^{{S}}+|{{S}}+$', '', 'g'), '|' ORDER BY pos) AS said, string_agg('scroll', '|') AS scrolls FROM ({MESSAGES}) GROUP BY conv_id)
SELECT conv_id, n + 2 AS n_messages, CASE WHEN more THEN ' said ' || chr(133) ELSE '' END AS draft, waiting AND NOT more AS loading, more AS failed, more AS favorites_only, n + 3 + CASE WHEN more THEN 3 ELSE 0 END AS n_events,
    CASE WHEN more THEN 'old-1,old-2' ELSE 'old-1' END AS favorites, 'scroll|Imported history: 2 messages.|scroll|' || scrolls || CASE WHEN more THEN '|History exported to /x.json|Export failed. Please try again.|Import failed. Invalid file.' ELSE '' END AS events, 'before|then|' || said AS texts FROM s""".replace("{S}", SPACES)


def reducer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reducer.events(reducer.replay(all_actions(messages(spark, sf_dir))))


EVENTS = f"""WITH e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, k) - 1 AS at, event FROM (
    SELECT DISTINCT conv_id, -10 AS place, unnest([0, 1, 2]) AS k, unnest(['scroll', 'Imported history: 2 messages.', 'scroll']) AS event FROM ({MESSAGES})
    UNION ALL SELECT conv_id, pos, 0, 'scroll' FROM ({MESSAGES})
    UNION ALL SELECT DISTINCT conv_id, 1000000, unnest([0, 1, 2]), unnest(['History exported to /x.json', 'Export failed. Please try again.', 'Import failed. Invalid file.']) FROM ({MESSAGES}) WHERE conv_id % 2 = 0))
SELECT * FROM e"""

def replay_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread.summary(spread.walked(all_actions(messages(spark, sf_dir))))


def replay_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread.messages(spread.walked(all_actions(messages(spark, sf_dir))))


REPLAY_MESSAGES = f"""WITH m AS ({MESSAGES}), c AS (SELECT DISTINCT conv_id FROM m),
a AS (SELECT conv_id, pos * 2 + CASE author WHEN 'USER' THEN 1 ELSE 0 END AS seq, author, CASE author WHEN 'USER' THEN regexp_replace(text, '^{SPACES}+|{SPACES}+$', '', 'g') ELSE text END AS text FROM m)
SELECT conv_id, seq, 0 AS at, conv_id || '-' || seq AS id, author, text, false AS is_favorite FROM a
UNION ALL SELECT conv_id, -8, 0, 'old-1', 'USER', 'before', true FROM c UNION ALL SELECT conv_id, -8, 1, 'old-2', 'ASSISTANT', 'then', conv_id % 2 = 0 FROM c"""


def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread.events(spread.walked(all_actions(messages(spark, sf_dir))))


REPLAY_EVENTS = f"""WITH m AS ({MESSAGES}), c AS (SELECT DISTINCT conv_id FROM m)
SELECT conv_id, pos * 2 + CASE author WHEN 'USER' THEN 1 ELSE 0 END AS seq, 0 AS at, 'scroll' AS event FROM m
UNION ALL SELECT conv_id, unnest([-10, -8, -8]), unnest([0, 0, 1]), unnest(['scroll', 'Imported history: 2 messages.', 'scroll']) FROM c
UNION ALL SELECT conv_id, unnest([1000005, 1000006, 1000007]), 0, unnest(['History exported to /x.json', 'Export failed. Please try again.', 'Import failed. Invalid file.']) FROM c WHERE conv_id % 2 = 0"""


def prefix_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.chain(messages(spark, sf_dir), SYSTEM)


def prefix_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct prefix once, with the number of conversations that share it: every conversation goes on from the first
    two places of the one whose number is the tens before its own."""
    m = messages(spark, sf_dir)
    begun = m.where("conv_id % 10 = 0 and pos < 2").select(F.col("conv_id").alias("base"), (F.col("pos") - 1000).alias("pos"), "id", "author", "text", "is_favorite")
    forks = m.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % 10).join(begun, "base").drop("base")
    return prefixes.shared(prefixes.chain(m.unionByName(forks), SYSTEM)).select("digest", "parent", "n_turns", "n_convs", "conv_id")


FORKED = f"SELECT conv_id, pos, author, text FROM ({MESSAGES}) UNION ALL SELECT c.conv_id, h.pos - 1000, h.author, h.text FROM (SELECT DISTINCT conv_id FROM ({MESSAGES})) c JOIN ({MESSAGES}) h ON h.conv_id = c.conv_id - c.conv_id % 10 AND h.pos < 2"


def prefix_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of every user turn, put together from its prefix's digest."""
    m = messages(spark, sf_dir)
    links = prefixes.chain(m, SYSTEM)
    asked = links.where("author = 'USER'")
    return asked.join(prefixes.payloads(m, links, asked, MODEL, SYSTEM), "digest").select("conv_id", "pos", "payload")


def _chain_sql(source: str) -> str:
    part = lambda sha, at: f"('0x' || substr({sha}, {at}, 15))::HUGEINT"
    half = lambda i, at: f"list_reduce(list_prepend({part(f"sha256('{SYSTEM}')", at)}, list_transform(hashes, lambda h: {part('h', at)})), lambda x, y: (x * {prefixes.BASES[i]}::HUGEINT + y) % {prefixes.PRIME}::HUGEINT)"
    return f"""c0 AS (SELECT conv_id, pos, author, sha256(CASE author WHEN 'ASSISTANT' THEN 'assistant' ELSE 'user' END || chr(10) || text) AS hash FROM ({source})),
c1 AS (SELECT conv_id, pos, author, list(hash) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hashes FROM c0),
c2 AS (SELECT *, printf('%016x%016x', ({half(0, 1)})::BIGINT, ({half(1, 16)})::BIGINT) AS digest FROM c1),
c AS (SELECT conv_id, pos, author, len(hashes) AS n_turns, digest, coalesce(lag(digest) OVER (PARTITION BY conv_id ORDER BY pos), printf('%016x%016x', {part(f"sha256('{SYSTEM}')", 1)}::BIGINT, {part(f"sha256('{SYSTEM}')", 16)}::BIGINT)) AS parent FROM c2)"""


PREFIX_CHAIN = f"WITH {_chain_sql(MESSAGES)} SELECT * FROM c"
PREFIX_SHARING = f"WITH {_chain_sql(FORKED)} SELECT digest, any_value(parent) AS parent, any_value(n_turns) AS n_turns, count(*) AS n_convs, min(conv_id) AS conv_id FROM c GROUP BY digest"

def random_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new 64-bit id for each message."""
    m = messages(spark, sf_dir)
    return m.select("conv_id", "pos", ids.random_id(ids.counter(F.col("conv_id"), F.col("pos")), seed=5).alias("id"))


def _offline(payloads: list[str]) -> list[str]:
    """A completion service for queries: fails for one payload in four, else says the payload's digest."""
    out = []
    for payload in payloads:
        said = hashlib.sha256(payload.encode()).hexdigest()
        if said[0] in "0123":
            raise TimeoutError(f"no answer to {said[:8]}")
        out.append(json.dumps({"choices": [{"message": {"role": "assistant", "content": f" {said[:12]} "}}]}))
    return out


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user turn's request brings, failures as rows; the journal is kept in the shared folder, empty at first."""
    asked = prompt.requests(messages(spark, sf_dir), MODEL, SYSTEM).withColumn("seq", F.col("pos") * 2 + 2)
    done = completion.complete(asked, _offline, f"{segments.shared_folder(spark)}/completions-{uuid.uuid4().hex}", at_once=8)
    return completion.reply_actions(done)


PAYLOAD = f"""WITH m AS (SELECT conv_id, pos, author, {{'role': CASE author WHEN 'ASSISTANT' THEN 'assistant' ELSE 'user' END, 'content': text}} AS m FROM ({MESSAGES})),
w AS (SELECT conv_id, pos, author, list(m) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sent FROM m)
SELECT conv_id, pos, CAST(to_json({{'model': '{MODEL}', 'messages': list_concat([{{'role': 'system', 'content': '{SYSTEM}'}}], sent), 'stream': false}}) AS VARCHAR) AS payload FROM w WHERE author = 'USER'"""

EXPORT = f"""SELECT conv_id, '{{' || chr(10) || '  "version" : 1,' || chr(10) || '  "messages" : [ ' || string_agg('{{' || chr(10) || '    "id" : ' || to_json(id) || ',' || chr(10) || '    "author" : ' || to_json(author) || ',' || chr(10)
    || '    "text" : ' || to_json(text) || ',' || chr(10) || '    "isFavorite" : ' || to_json(is_favorite) || chr(10) || '  }}', ', ' ORDER BY pos) || ' ]' || chr(10) || '}}' AS json FROM ({MESSAGES}) GROUP BY conv_id"""

VOICE = [
    (1, 1, "start", None, None, True, True), (1, 2, "partial", ["hel"], None, None, None), (1, 3, "partial", ["hello", "hallo"], None, None, None), (1, 4, "final", ["hello there"], None, None, None), (1, 5, "partial", ["  "], None, None, None),
    (2, 1, "toggle", None, None, True, True), (2, 2, "partial", ["a"], None, None, None), (2, 3, "toggle", None, None, None, None), (2, 4, "final", ["late"], None, None, None),
    (3, 1, "start", None, None, True, False),
    (4, 1, "start", None, None, False, True), (4, 2, "permission", None, None, False, None),
    (5, 1, "start", None, None, False, True), (5, 2, "permission", None, None, True, None), (5, 3, "partial", ["x"], None, None, None), (5, 4, "error", None, 7, None, None),
    (6, 1, "stop", None, None, None, None), (7, 1, "start", None, None, True, True), (7, 2, "error", None, 99, None, None),
]
VOICE_SCHEMA = "session bigint, seq bigint, kind string, hypotheses array<string>, error_code int, granted boolean, available boolean"


def voice_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOICE, VOICE_SCHEMA)


def voice_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.range(0, 12).select(F.col("id").cast("int").alias("code"))
    return codes.select("code", voice.error_text(F.col("code")).alias("message"))


NAMES = [("feature", "sleep_timer"), ("core", "a__b1_2c"), ("feature", "Sleep"), ("feature", "1a"), ("feature", "abc\n"), ("core", "x")]
NAME_SQL = f"""WITH n AS (SELECT * FROM {_values(NAMES, 'area, name')}),
p AS (SELECT *, array_to_string(list_transform(list_filter(string_split(name, '_'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM n)
SELECT area, name, regexp_full_match(name, '[a-z][a-z0-9_]*') AS valid, 'org.example.' || area || '.' || name AS package, pascal, lower(pascal[1]) || pascal[2:] AS camel FROM p"""


def name_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.derive_names(spark.createDataFrame(NAMES, "area string, name string"))


def name_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.functions import text as X

    rows = spark.createDataFrame([("SleepTimer",), ("sleep",), ("A_b",), ("A1",), ("Ab\n",)], "name string")
    return rows.select("name", X.is_pascal(F.col("name")).alias("pascal"), X.is_snake(F.col("name")).alias("snake"))


FLAGS = [(1, "", False, False, []), (2, " nav, data ", False, False, []), (3, "nav", True, False, []), (4, "nav", False, False, ["data"]), (5, "nav", False, True, []), (6, "", True, True, []), (7, "", False, True, ["data"]), (8, "", True, False, ["domain"]), (9, "", False, False, ["nav"]), (10, "nav,ui", False, False, []), (11, "", False, False, ["ui"])]
LAYER_SQL = "SELECT * FROM " + _values(
    [(1, None, True, False, False, False), (2, None, True, False, False, True), (3, "list with all or without", None, None, None, None), (4, "list with all or without", None, None, None, None), (5, "list with view model", None, None, None, None), (6, "all with view model", None, None, None, None), (7, None, True, True, False, False), (8, None, True, True, False, True), (9, None, False, True, True, True), (10, "unknown layer", None, None, None, None), (11, "unknown layer", None, None, None, None)],
    "id, error, nav, presentation, domain, data",
)
TEMPLATES = [(1, "package {{PACKAGE}}.{{AREA}}\nclass {{NAME}}Screen // {{name}} {{FEATURE}} {{Name}}", "org.example", "feature", "sleep_timer", "SleepTimer", "sleepTimer")]
FILES, SYMBOLS = [("m.kt", "factoryOf(::AUseCase)"), ("n.kt", "")], [("m.kt", "::AUseCase"), ("m.kt", "::AViewModel"), ("n.kt", "::B")]
CHANGED = [(1, "a/b.kt, a/build/c.kt ,d.java"), (2, "e.kt"), (3, "x/showcaseApp/y.kt,build/z.kt")]
SETTINGS = ["// Core modules", 'include(":core:a")', "", "// Feature modules", 'include(":feature:a")', 'include(":feature:b")', "// end", 'include(":other:x")']
AGGREGATE = ["package org.example.di", "", "import org.example.a.aModule", "import org.example.z.zModule", "", "val all = module {", "    includes(", "        aModule,", "        zModule", "    )", "}"]


def _lines(spark: SparkSession, name: str, rows: list[str]) -> DataFrame:
    return spark.createDataFrame([(name, i, x) for i, x in enumerate(rows)], "file string, pos bigint, line string")


def _lines_sql(name: str, rows: list[str]) -> str:
    return "SELECT * FROM " + _values([(name, i, x) for i, x in enumerate(rows)], "file, pos, line")


def wire_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines for two sections, a section that isn't there, and a line that is."""
    plan = [("// Feature modules", 'include(":feature:c")'), ("// Feature modules", 'include(":feature:aa")'), ("// Core modules", 'include(":core:b")'), ("// None", 'include(":z")'), ("// Core modules", 'include(":feature:b")')]
    return scaffold.wire_include(_lines(spark, "settings", SETTINGS), spark.createDataFrame([("settings", *p) for p in plan], "file string, section string, new string"))


def wire_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = ["import org.example.c.cModule", "import org.example.b.bModule", "import zz", "import org.example.a.aModule"]
    return scaffold.wire_import(_lines(spark, "all", AGGREGATE), spark.createDataFrame([("all", n) for n in new], "file string, new string"))


def wire_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.wire_entry(_lines(spark, "all", AGGREGATE), spark.createDataFrame([("all", n) for n in ("cModule", "bModule", "aModule")], "file string, new string"))


WIRED = [("all", "import org.example.c.cModule", "cModule"), ("all", "import org.example.a.aModule", "aModule"), ("none", "import org.example.a.aModule", "aModule")]


def wire_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _lines(spark, "all", AGGREGATE).unionByName(_lines(spark, "none", AGGREGATE))
    return scaffold.wire_module(both, spark.createDataFrame(WIRED, "file string, import_line string, entry string"))


def wire_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _lines(spark, "all", AGGREGATE).unionByName(_lines(spark, "none", AGGREGATE))
    changes = scaffold.wire_changes(both, spark.createDataFrame(WIRED, "file string, import_line string, entry string"))
    return changes.withColumn("added", F.array_join("added", "|"))


FEATURES = [("org.example.feature.sleep_timer", "sleep_timer", "SleepTimer", "sleepTimer", True, True, True), ("org.example.feature.a", "a", "Extra", "extra", False, True, False), ("org.example.feature.b", "b", "B", "b", True, False, True), ("org.example.feature.c", "c", "C", "c", False, False, False)]
EXISTING = [("di/BModule.kt", "factoryOf(::BRepositoryImpl)")]


def module_files(spark: SparkSession, sf_dir: str, force: bool = False) -> DataFrame:
    wanted = spark.createDataFrame(FEATURES, "package string, feature string, pascal string, camel string, has_data boolean, has_domain boolean, has_presentation boolean")
    made = scaffold.modules(wanted, spark.createDataFrame(EXISTING, "path string, content string"), force)
    return made.withColumn("pending", F.array_join("pending", "|"))


_TIMER = """package org.example.feature.sleep_timer.di

import org.example.feature.sleep_timer.data.repository.SleepTimerRepositoryImpl
import org.example.feature.sleep_timer.domain.repository.SleepTimerRepository
import org.example.feature.sleep_timer.domain.usecase.SleepTimerUseCase
import org.example.feature.sleep_timer.presentation.SleepTimerViewModel
import org.koin.core.annotation.KoinExperimentalAPI
import org.koin.core.module.Module
import org.koin.core.module.dsl.factoryOf
import org.koin.core.module.dsl.viewModelOf
import org.koin.dsl.bind
import org.koin.dsl.module

@OptIn(KoinExperimentalAPI::class)
val sleepTimerModule: Module = module {
    factoryOf(::SleepTimerRepositoryImpl) bind SleepTimerRepository::class
    factoryOf(::SleepTimerUseCase)
    viewModelOf(::SleepTimerViewModel)
}
"""
_EXTRA = """package org.example.feature.a.di

import org.example.feature.a.domain.usecase.ExtraUseCase
import org.koin.core.module.Module
import org.koin.core.module.dsl.factoryOf
import org.koin.dsl.module

val aModule: Module = module {
    factoryOf(::ExtraUseCase)
}
"""
_FORCED = """package org.example.feature.b.di

import org.example.feature.b.data.repository.BRepositoryImpl
import org.example.feature.b.domain.repository.BRepository
import org.example.feature.b.presentation.BViewModel
import org.koin.core.annotation.KoinExperimentalAPI
import org.koin.core.module.Module
import org.koin.core.module.dsl.factoryOf
import org.koin.core.module.dsl.viewModelOf
import org.koin.dsl.bind
import org.koin.dsl.module

@OptIn(KoinExperimentalAPI::class)
val bModule: Module = module {
    factoryOf(::BRepositoryImpl) bind BRepository::class
    viewModelOf(::BViewModel)
}
"""


def _modules_sql(forced: bool) -> str:
    b = ("b", "B", "di/BModule.kt", "CREATE", _FORCED, "", True) if forced else ("b", "B", "di/BModule.kt", "SKIP", None, "// в BModule.kt добавь: viewModelOf(::BViewModel)", False)
    rows = [("sleep_timer", "SleepTimer", "di/SleepTimerModule.kt", "CREATE", _TIMER, "", True), ("a", "Extra", "di/AModule.kt", "CREATE", _EXTRA, "", True), b, ("c", "C", None, None, None, "", False)]
    return "SELECT * FROM " + _values(rows, "feature, pascal, target, action, content, pending, created_now")


TREE = [("a.kt", "old"), ("b.kt", "b")]
TARGETS = [("a.kt", "new"), ("c/.gitkeep", None), ("d.kt", "d")]


def _tree(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "path string, content string")


MODULES = [("A", True, True, True), ("B", False, True, False), ("C", False, False, False)]

Query = Callable[[SparkSession, str], DataFrame]
#: name: (query, SQL or None)
ALL: dict[str, tuple[Query, str | None]] = {
    "load_messages": (messages, MESSAGES),
    "author_fallback": (author_fallback, "SELECT conv_id, turn AS pos, CASE WHEN role = 'assistant' THEN 'ASSISTANT' ELSE 'USER' END AS author FROM conversations"),
    "favorites_view": (lambda s, d: view.favorites(messages(s, d)), f"SELECT * FROM ({MESSAGES}) WHERE is_favorite"),
    "favorites_count": (lambda s, d: view.favorites_count(messages(s, d)), f"SELECT conv_id, count(*) FILTER (is_favorite) AS n_favorites, count(*) AS n_messages FROM ({MESSAGES}) GROUP BY conv_id"),
    "view_rows": (lambda s, d: view.view_rows(messages(s, d)), f"SELECT conv_id, pos, id, text, author = 'USER' AS is_from_user, author <> 'USER' AS is_speakable, is_favorite, author <> 'USER' AS can_favorite FROM ({MESSAGES})"),
    "view_flags": (view_flags, VIEW_FLAGS),
    "toggle_favorite": (toggle_favorite, f"WITH m AS ({MESSAGES}), k AS (SELECT conv_id, min(pos) AS first FROM m WHERE author = 'ASSISTANT' GROUP BY conv_id) SELECT conv_id, pos, id, author, text, CASE WHEN pos = first THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM m LEFT JOIN k USING (conv_id)"),
    "append_message": (append_message, f"WITH m AS ({MESSAGES}) SELECT * FROM m UNION ALL SELECT conv_id, max(pos) + 1, 'new-' || conv_id, 'USER', 'thanks', false FROM m GROUP BY conv_id"),
    "send_guard": (send_guard, SEND_GUARD),
    "history_merge": (lambda s, d: history.merge(*_sides(s, d)), _merge_sql("id")),
    "history_merge_dups": (lambda s, d: history.merge(*_sides(s, d, copies=True)), _merge_sql("conv_id || '-' || pos % 3")),
    "history_replace": (history_replace, f"WITH m AS ({MESSAGES}), i AS (SELECT * FROM m WHERE conv_id % 2 = 0 AND pos >= 2) SELECT * FROM i UNION ALL SELECT * FROM m WHERE conv_id NOT IN (SELECT conv_id FROM i)"),
    "bucketed_merge": (bucketed_merge, BUCKETED_MERGE),
    "import_notice": (import_notice, f"SELECT conv_id, 'Imported history: ' || count(*) || ' messages.' AS notice FROM ({_merge_sql('id')}) GROUP BY conv_id"),
    "prompt_roles": (lambda s, d: prompt.roles(messages(s, d)), f"SELECT conv_id, pos, CASE author WHEN 'ASSISTANT' THEN 'assistant' ELSE 'user' END AS role, text AS content FROM ({MESSAGES})"),
    "prompt_context_stats": (lambda s, d: prompt.context_stats(messages(s, d)), f"SELECT conv_id, pos, n_messages, n_chars FROM (SELECT *, count(*) OVER w AS n_messages, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars FROM ({MESSAGES}) WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) WHERE author = 'USER'"),
    "prompt_payload": (lambda s, d: prompt.requests(messages(s, d), MODEL, SYSTEM), PAYLOAD),
    "response_extract": (response_extract, "SELECT * FROM " + _values([("one", True, "ASSISTANT", "hi"), ("two", True, "ASSISTANT", "first"), ("none", True, "ASSISTANT", ""), ("lenient", True, "ASSISTANT", "ok"), ("missing", False, None, None), ("null", False, None, None)], "id, ok, author, text")),
    "history_strict_decode": (history_strict_decode, STRICT),
    "history_roundtrip": (history_roundtrip, ROUNDTRIP),
    "export_document": (lambda s, d: source.encode(messages(s, d)), EXPORT),
    "reducer_replay": (reducer_replay, REPLAY),
    "reducer_events": (reducer_events, EVENTS),
    "replay_spread": (replay_spread, f"SELECT conv_id, n_messages, draft, loading, failed, favorites_only, n_events FROM ({REPLAY})"),
    "replay_messages": (replay_messages, REPLAY_MESSAGES),
    "replay_events": (replay_events, REPLAY_EVENTS),
    "prefix_chain": (prefix_chain, PREFIX_CHAIN),
    "prefix_sharing": (prefix_sharing, PREFIX_SHARING),
    "prefix_payload": (prefix_payload, PAYLOAD),
    "random_ids": (random_ids, f"SELECT conv_id, pos, {ids.sql('conv_id * 4294967296 + pos', seed=5)} AS id FROM ({MESSAGES})"),
    "completions": (completions, f"SELECT conv_id, pos * 2 + 2 AS seq, CASE WHEN sha256(payload)[1] IN ('0', '1', '2', '3') THEN 'ReplyFailed' ELSE 'ReplyReceived' END AS action, CASE WHEN sha256(payload)[1] NOT IN ('0', '1', '2', '3') THEN sha256(payload)[1:12] END AS text FROM ({PAYLOAD})"),
    "transcript_latest": (lambda s, d: voice.latest_transcript(voice_events(s)), "SELECT * FROM " + _values([(1, "hello there"), (2, "late"), (5, "x")], "session, draft")),
    "voice_states": (lambda s, d: voice.states(voice_events(s)), "SELECT * FROM " + _values([(1, "Idle", None), (2, "Idle", None), (3, "Unavailable", None), (4, "PermissionDenied", None), (5, "Failed", voice.ERRORS[7]), (6, "Idle", None), (7, "Failed", voice.OTHER_ERROR)], "session, state, message")),
    "voice_errors": (voice_errors, "SELECT CAST(range AS INTEGER) AS code, CASE range " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in voice.ERRORS.items()) + f" ELSE '{voice.OTHER_ERROR}' END AS message FROM range(12)"),
    "name_derive": (name_derive, NAME_SQL),
    "name_validate": (name_validate, "SELECT name, regexp_full_match(name, '[A-Z][A-Za-z0-9]*') AS pascal, regexp_full_match(name, '[a-z][a-z0-9_]*') AS snake FROM " + _values([("SleepTimer",), ("sleep",), ("A_b",), ("A1",), ("Ab\n",)], "name")),
    "layer_resolve": (lambda s, d: scaffold.resolve_layers(s.createDataFrame(FLAGS, "id bigint, layers string, all_layers boolean, with_view_model boolean, without array<string>")), LAYER_SQL),
    "template_render": (lambda s, d: scaffold.render(s.createDataFrame(TEMPLATES, "id bigint, content string, package string, area string, feature string, pascal string, camel string")), "SELECT id, replace(replace(replace(replace(replace(content, '{{PACKAGE}}', package), '{{AREA}}', area), '{{FEATURE}}', feature), '{{NAME}}', pascal), '{{name}}', camel) AS content FROM " + _values(TEMPLATES, "id, content, package, area, feature, pascal, camel")),
    "write_plan": (lambda s, d: scaffold.write_plan(s.createDataFrame([("a",), ("b",)], "path string"), s.createDataFrame([("b",)], "path string")), "SELECT * FROM " + _values([("a", "CREATE"), ("b", "SKIP")], "path, action")),
    "missing_bindings": (lambda s, d: scaffold.missing_bindings(s.createDataFrame(FILES, "file string, content string"), s.createDataFrame(SYMBOLS, "file string, symbol string")), f"SELECT s.file, s.symbol FROM {_values(SYMBOLS, 'file, symbol').replace('AS t(', 'AS s(')} JOIN {_values(FILES, 'file, content').replace('AS t(', 'AS f(')} ON s.file = f.file WHERE NOT contains(f.content, s.symbol)"),
    "changed_files": (lambda s, d: scaffold.changed_files(s.createDataFrame(CHANGED, "id bigint, csv string")), f"SELECT id, path FROM (SELECT id, trim(unnest(string_split(csv, ','))) AS path FROM {_values(CHANGED, 'id, csv')}) WHERE ends_with(path, '.kt') AND NOT contains('/' || path, '/build/') AND NOT contains('/' || path, '/showcaseApp/')"),
    "module_assemble": (lambda s, d: scaffold.module_lines(s.createDataFrame(MODULES, "pascal string, has_data boolean, has_domain boolean, has_presentation boolean")), "SELECT * FROM " + _values([("A", "    factoryOf(::ARepositoryImpl) bind ARepository::class\n    factoryOf(::AUseCase)\n    viewModelOf(::AViewModel)"), ("B", "    factoryOf(::BUseCase)"), ("C", None)], "pascal, body")),
    "module_files": (module_files, _modules_sql(False)),
    "module_files_forced": (lambda s, d: module_files(s, d, force=True), _modules_sql(True)),
    "write_files": (lambda s, d: scaffold.write(_tree(s, TARGETS), _tree(s, TREE)), "SELECT * FROM " + _values([*TREE, ("c/.gitkeep", ""), ("d.kt", "d")], "path, content")),
    "write_files_forced": (lambda s, d: scaffold.write(_tree(s, TARGETS), _tree(s, TREE), force=True), "SELECT * FROM " + _values([("a.kt", "new"), ("b.kt", "b"), ("c/.gitkeep", ""), ("d.kt", "d")], "path, content")),
    "write_report": (lambda s, d: scaffold.report(scaffold.write_plan(_tree(s, TARGETS), _tree(s, TREE))), "SELECT * FROM " + _values([("skip   a.kt\ncreate c/.gitkeep\ncreate d.kt",)], "report")),
    "actions_shown": (lambda s, d: view.view_rows(messages(s, d)).select("conv_id", "pos", *(c.alias(n) for n, c in view.actions_shown(F.col("is_speakable"), F.col("can_favorite"), F.col("conv_id") % 2 == 0).items())), f"SELECT conv_id, pos, author <> 'USER' AS has_actions, author <> 'USER' AND conv_id % 2 = 0 AS can_speak FROM ({MESSAGES})"),
    "wire_include": (wire_include, _lines_sql("settings", [*SETTINGS[:2], 'include(":core:b")', *SETTINGS[2:6], 'include(":feature:aa")', 'include(":feature:c")', *SETTINGS[6:], 'include(":z")'])),
    "wire_import": (wire_import, _lines_sql("all", [*AGGREGATE[:3], "import org.example.b.bModule", "import org.example.c.cModule", AGGREGATE[3], "import zz", *AGGREGATE[4:]])),
    "wire_entry": (wire_entry, _lines_sql("all", [*AGGREGATE[:8], "        zModule,", "        bModule,", "        cModule", *AGGREGATE[9:]])),
    "wire_module": (wire_module, _lines_sql("all", [*AGGREGATE[:3], "import org.example.c.cModule", *AGGREGATE[3:8], "        zModule,", "        cModule", *AGGREGATE[9:]]) + " UNION ALL " + _lines_sql("none", AGGREGATE)),
    "wire_changes": (wire_changes, "SELECT * FROM " + _values([("all", "import org.example.c.cModule|cModule,", False), ("none", "import org.example.a.aModule|aModule,", True)], "file, added, already_present")),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
