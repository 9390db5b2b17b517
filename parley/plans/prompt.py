"""Prompt requests from histories, and replies from responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import trim
from parley.schema import RESPONSE


def role():
    return F.when(F.col("author") == "ASSISTANT", "assistant").otherwise("user")


def roles(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id", "pos", role().alias("role"), F.col("text").alias("content"))


def context_stats(messages: DataFrame) -> DataFrame:
    """What each user turn sends, counted: running sums, so linear in the turns."""
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = messages.select("conv_id", "pos", "author", F.count(F.lit(1)).over(so_far).alias("n_messages"), F.sum(F.length("text").cast("bigint")).over(so_far).alias("n_chars"))
    return counted.where("author = 'USER'").drop("author")


def requests(messages: DataFrame, model: str, system: str) -> DataFrame:
    """The request of each user turn: the system prompt, then the whole history up to it.

    The payload is quadratic in the turns by nature; the prefix of each user turn is cut
    from one array per conversation."""
    row = F.struct("pos", F.struct(role().alias("role"), F.col("text").alias("content")).alias("m"), "author")
    whole = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    turns = whole.select("conv_id", "rows", F.posexplode("rows").alias("i", "turn")).where("turn.author = 'USER'")
    first = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
    sent = F.concat(F.array(first), F.expr("slice(rows.m, 1, i + 1)"))
    payload = F.to_json(F.struct(F.lit(model).alias("model"), sent.alias("messages"), F.lit(False).alias("stream")))
    return turns.select("conv_id", "turn.pos", payload.alias("payload"))


def replies(responses: DataFrame) -> DataFrame:
    """text of responses (id, json): the first choice's content, trimmed; empty without choices. Unknown keys
    and lenient JSON pass; one without choices or content fails (ok false, text null)."""
    parsed = F.from_json("json", RESPONSE, {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})
    choices = parsed["choices"]
    ok = choices.isNotNull() & F.forall(choices, lambda c: c["message"]["content"].isNotNull())
    text = trim(F.coalesce(F.try_element_at(choices, F.lit(1))["message"]["content"], F.lit("")))
    ok = F.coalesce(ok, F.lit(False))
    return responses.select("id", ok.alias("ok"), F.when(ok, F.lit("ASSISTANT")).alias("author"), F.when(ok, text).alias("text"))
