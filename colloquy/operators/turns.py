"""Cleaning, pairing and numbering of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.text import is_blank, strip
from colloquy.operators.chunks import CHUNK, Chunks, Fold, measure, released, scan

TURN_KEY = "conv_id"
TURN_ORDER = ("turn",)


def clean_turns(turns: DataFrame) -> DataFrame:
    """Strip user text and drop user turns left empty; replies stay as they are."""
    asked = F.col("role") == "user"
    text = F.col("text")
    return turns.where(~asked | ~is_blank(text)).withColumn(
        "text", F.when(asked, strip(text)).otherwise(text)
    )


def turn_chunks(turns: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> Chunks:
    """Chunks for all jobs over the same turns; measure the raw turns, whose text is not read. With `max_bytes`
    conversations are cut by the bytes of their texts instead, which reads them once."""
    if max_bytes is None:
        return measure(turns, TURN_KEY, TURN_ORDER, max_rows)
    return measure(turns, TURN_KEY, TURN_ORDER, weight=F.octet_length("text"), max_weight=max_bytes)


def pair_exchanges(turns: DataFrame, chunks: Chunks | None = None) -> DataFrame:
    """One row per user turn with the reply that follows it directly, if there is one.

    Other columns of the turns are not kept.
    """
    chunks = chunks or turn_chunks(turns)
    ahead = scan(
        turns, chunks, {"_next_role": Fold("lead", "role"), "_next_text": Fold("lead", "text")}
    )
    reply = F.when(F.col("_next_role") == "ai", F.col("_next_text"))
    kept = [c for c in (CHUNK,) if c in turns.columns]
    return (
        ahead.where(F.col("role") == "user")
        .withColumn("reply", reply)
        .select(
            chunks.key,
            *chunks.order,
            F.col("text").alias("message"),
            "reply",
            F.col("reply").isNotNull().alias("answered"),
            *kept,
        )
    )


def number_messages(
    turns: DataFrame, chunks: Chunks | None = None, weight: str | None = None
) -> DataFrame:
    """Turns with their 0-based `number` in the conversation.

    A message takes one number; `weight` names a column with the count of numbers it takes, of which
    it shows the last. A turn with a true `hidden`, where there is such a column, takes and shows none.
    """
    chunks = chunks or turn_chunks(turns)
    each = F.col(weight) if weight else F.lit(1)
    counted = turns.withColumn("_weight", F.when(is_hidden(turns), 0).otherwise(each))
    numbered = scan(counted, chunks, {"number": Fold("total", "_weight")})
    shown = F.when(~is_hidden(turns), F.col("number") - 1)
    return released(numbered.withColumn("number", shown).drop("_weight"), turns)


def is_hidden(rows: DataFrame) -> Column:
    """Whether a turn is one that was never shown, such as a greeting sent on behalf of the user."""
    return F.coalesce(F.col("hidden"), F.lit(False)) if "hidden" in rows.columns else F.lit(False)
