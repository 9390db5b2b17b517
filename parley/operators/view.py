"""What a reader sees of a history: filter, count, rows, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import is_blank


def favorites(messages: DataFrame, active: bool = True) -> DataFrame:
    return messages.where("is_favorite") if active else messages


def favorites_count(messages: DataFrame) -> DataFrame:
    """Over all messages of a conversation, whatever the filter."""
    return messages.groupBy("conv_id").agg(F.count_if("is_favorite").alias("n_favorites"), F.count(F.lit(1)).alias("n_messages"))


def view_rows(messages: DataFrame) -> DataFrame:
    user = F.col("author") == "USER"
    return messages.select("conv_id", "pos", "id", "text", user.alias("is_from_user"), (~user).alias("is_speakable"), "is_favorite", (~user).alias("can_favorite"))


def actions_shown(speakable: Column, can_favorite: Column, voice: Column) -> dict[str, Column]:
    """Whether a row has actions at all, and whether its speaker works."""
    return {"has_actions": speakable | can_favorite, "can_speak": speakable & voice}


def view_flags(states: DataFrame) -> DataFrame:
    """Flags of states (conv_id, draft, loading, failed, favorites_only, n_visible)."""
    only = F.col("favorites_only")
    spins, error = F.col("loading") & ~only, F.col("failed") & ~only
    empty = (F.col("n_visible") == 0) & ~spins & ~error
    return states.select(
        "conv_id",
        spins.alias("shows_spinner"),
        error.alias("shows_error"),
        (~is_blank(F.col("draft")) & ~F.col("loading")).alias("can_send"),
        F.when(empty & only, "no_favorites").when(empty, "no_messages").alias("hint"),
        F.greatest(F.col("n_visible") - 1, F.lit(0)).alias("last_index"),
    )
