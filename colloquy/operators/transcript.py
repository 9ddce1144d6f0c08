"""Numbered, labelled and escaped transcripts."""

from __future__ import annotations

from typing import Mapping, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.rules import INTENT_LABELS, INTENT_RULES, Rule
from colloquy.functions.text import escape_markup
from colloquy.operators.chunks import Chunks, Fold, measure, scan
from colloquy.operators.payloads import FAILURES
from colloquy.operators.tagging import attach_labels, tag_intent
from colloquy.operators.turns import TURN_KEY, is_hidden


class Party(NamedTuple):
    avatar: str
    sender: str


USER = Party("YOU", "You")
AGENT = Party("PW", "Assistant")


def transcript(
    turns: DataFrame,
    rules: Sequence[Rule] = INTENT_RULES,
    labels: Mapping[str, str | None] | DataFrame = INTENT_LABELS,
    user: Party = USER,
    agent: Party = AGENT,
    order: Sequence[str] = ("turn",),
    chunks: Chunks | None = None,
) -> DataFrame:
    """Turns as shown: number, avatar, sender, label of the question answered, escaped text.

    A boolean column `failed` marks replies that stand for a failure; they get no label. An integer column
    `weight` gives the numbers a message takes, see `number_messages`. Turns with a true `hidden` have no row
    and take no number, but the reply to one is labelled after it.
    """
    chunks = chunks or measure(turns, TURN_KEY, tuple(order))
    weight = F.col("weight") if "weight" in turns.columns else F.lit(1)
    # Replies are not classified, so they are not lower-cased either.
    questions = turns.withColumn("_question", F.when(F.col("role") == "user", F.col("text")))
    asked = (
        tag_intent(questions, rules, text="_question", into="_asked")
        .withColumns(
            {
                "_asked": F.when(F.col("role") == "user", F.col("_asked")),
                "_weight": F.when(is_hidden(turns), 0).otherwise(weight),
                "_hidden": is_hidden(turns),
            }
        )
        .drop("_question")
    )
    seen = scan(asked, chunks, {"_total": Fold("total", "_weight"), "intent": Fold("lag", "_asked")})
    shown = F.col("role") == "ai"
    if "failed" in turns.columns:
        shown = shown & ~F.coalesce(F.col("failed"), F.lit(False))
    labelled = attach_labels(seen.withColumn("intent", F.when(shown, F.col("intent"))), labels)
    numbered = labelled.where(~F.col("_hidden")).withColumn("number", F.col("_total") - 1)
    return numbered.select(chunks.key, *order, *displayed(user, agent))


def displayed(user: Party = USER, agent: Party = AGENT) -> list[Column]:
    """What is shown of a numbered and labelled turn."""
    by_agent = F.col("role") == "ai"
    return [
        F.col("number"),
        F.col("role"),
        F.when(by_agent, agent.avatar).otherwise(user.avatar).alias("avatar"),
        F.when(by_agent, agent.sender).otherwise(user.sender).alias("sender"),
        F.col("label"),
        escape_markup(F.col("text")).alias("html"),
    ]


def turns_of_outcomes(outcomes: DataFrame, count_failed_twice: bool = False) -> DataFrame:
    """Exchanges with normalised payloads as turns: the message, and the reply or failure after it.

    Gives (conv_id, turn, slot, role, text, failed, weight, hidden), ordered by turn and slot. The numbering that
    lets a reply of the wrong type use up two numbers is an option. The message of an exchange with a true `hidden`
    is hidden, its reply is not.
    """
    failed = F.col("status").isin(*FAILURES)
    twice = (F.col("status") == "bad_type") if count_failed_twice else F.lit(False)
    said = F.array(
        F.struct(
            F.lit(0).alias("slot"),
            F.lit("user").alias("role"),
            F.col("message").alias("text"),
            F.lit(False).alias("failed"),
            F.lit(1).alias("weight"),
            is_hidden(outcomes).alias("hidden"),
        ),
        F.struct(
            F.lit(1).alias("slot"),
            F.lit("ai").alias("role"),
            F.col("reply").alias("text"),
            failed.alias("failed"),
            F.when(twice, 2).otherwise(1).alias("weight"),
            F.lit(False).alias("hidden"),
        ),
    )
    turns = outcomes.select(TURN_KEY, "turn", "status", F.inline(said))
    return turns.where((F.col("slot") == 0) | F.col("status").isNotNull()).drop("status")
