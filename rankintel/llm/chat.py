"""Chat formatting by perspective rotation: each participant of a dialogue in turn is the assistant.

For every participant the whole dialogue is rendered with that speaker as assistant, all others as named users and
system turns as they are; the mask covers what the assistant says. A rendering is kept as one row per turn with its
place in the rendered dialogue, so that a conversation of any length is never gathered into one row or one task:
places are sums within blocks of turns, and sums of blocks. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|turn|>", "<|text|>", "<|end|>"
BLOCK_TURNS = 64


def _clean(value: Column) -> Column:
    """Text in which nothing can be read as one of the markers."""
    return F.replace(F.coalesce(value, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: str = "system",
) -> DataFrame:
    """One row per conversation, perspective and turn.

    Columns: the conversation and turn columns, perspective, speaker, chat_role (assistant, user, system), name (of
    users), segment (the rendered turn), start and length (its place in the rendered dialogue, in characters),
    mask_start and mask_length (what is trained on: text and end marker of the assistant, else length 0).

    Turns go by their number, then speaker, then text; nulls first. A row that is repeated whole counts once. A null
    text is empty. Rows with a null speaker are spoken by no participant: they are shown as users without a name.
    Rows without a conversation belong to none and are left out. A conversation of system turns alone has no
    participant and no rendering.
    """
    rows = turns.select(
        F.col(conversation).alias("__conv"), F.col(turn).alias("__turn"), F.col(speaker).alias("__speaker"), F.coalesce(F.col(text), F.lit("")).alias("__text")
    ).where(F.col("__conv").isNotNull()).distinct()
    participants = turns.where((F.col(speaker) != system) & F.col(conversation).isNotNull()).select(F.col(conversation).alias("__conv"), F.col(speaker).alias("__as")).distinct()

    own = F.col("__speaker").eqNullSafe(F.col("__as"))
    role = F.when(own, "assistant").when(F.col("__speaker") == system, system).otherwise("user")
    name = F.when(role == "user", F.col("__speaker"))
    header = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" "), F.replace(name, F.lit("<|"), F.lit("< |"))), F.lit("")), F.lit(CLOSE))
    body = F.concat(_clean(F.col("__text")), F.lit(END))
    # A null turn comes before all others, and so does its block: below that of any number a turn can be.
    block = F.coalesce(F.floor(F.col("__turn").cast("double") / BLOCK_TURNS), F.lit(-(1 << 62)))
    shown = rows.join(participants, "__conv").select(
        "*", block.alias("__block"), role.alias("__role"), name.alias("__name"), F.concat(header, body).alias("__segment"), F.length(header).alias("__head")
    )
    blocks = shown.groupBy("__conv", "__as", "__block").agg(F.sum(F.length("__segment")).alias("__size"))
    earlier = Window.partitionBy("__conv", "__as").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("__conv", "__as", "__block", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__base"))

    within = Window.partitionBy("__conv", "__as", "__block").orderBy("__turn", "__speaker", "__text").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.repartition("__conv", "__as", "__block").withColumn("__before", F.coalesce(F.sum(F.length("__segment")).over(within), F.lit(0)))
    start = F.col("__base") + F.col("__before")
    return placed.join(bases, ["__conv", "__as", "__block"]).select(
        F.col("__conv").alias(conversation),
        F.col("__as").alias("perspective"),
        F.col("__turn").alias(turn),
        F.col("__speaker").alias("speaker"),
        F.col("__role").alias("chat_role"),
        F.col("__name").alias("name"),
        F.col("__segment").alias("segment"),
        start.alias("start"),
        F.length("__segment").cast("long").alias("length"),
        (start + F.col("__head")).alias("mask_start"),
        F.when(F.col("__role") == "assistant", F.length("__segment") - F.col("__head")).otherwise(0).cast("long").alias("mask_length"),
    )
