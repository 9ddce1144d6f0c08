"""Transcripts written as turns arrive."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from colloquy.functions.rules import INTENT_LABELS, INTENT_RULES, Rule
from colloquy.operators.tagging import attach_labels, tag_intent
from colloquy.operators.transcript import AGENT, USER, Party, displayed
from colloquy.operators.turns import TURN_KEY, is_hidden
from colloquy.streaming.ordered import Walk, walk_in_order


class TranscriptWalk(Walk):
    """Remembers how many messages were shown, and what the last turn asked."""

    state = "shown BIGINT, asked STRING"
    out = "turn BIGINT, number BIGINT, role STRING, intent STRING, text STRING, hidden BOOLEAN"

    def start(self) -> tuple:
        return (0, None)

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        _, turn, role, text, asked, failed, hidden, weight = row
        shown = state[0] + (0 if hidden else weight)
        intent = state[1] if role == "ai" and not failed else None
        return (shown, asked), [(turn, shown - 1, role, intent, text, hidden)]

    def late(self, row: tuple) -> tuple:
        _, turn, role, text, _, _, hidden, _ = row
        return (turn, None, role, None, text, hidden)


def transcript_stream(
    turns: DataFrame,
    time: str,
    rules: Sequence[Rule] = INTENT_RULES,
    labels: Mapping[str, str | None] = INTENT_LABELS,
    user: Party = USER,
    agent: Party = AGENT,
    delay: str = "0 seconds",
    marks: DataFrame | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """(conv_id, turn, number, role, avatar, sender, label, html, late) of a stream of turns, in append mode; rows are those
    of `transcript` where `time` grows with the turn. `failed`, `hidden` and `weight` are read where there are such columns.

    A message goes out when the watermark has passed it, with the next number of its conversation, which is kept in
    the state. A file sink commits a micro-batch and the state with it, so a stream that is killed and started
    again writes every message once, without a gap. Turns may arrive up to `delay` after later ones; one that
    comes after that goes out `late`, without a number. Two values are kept per conversation, for good. For `marks` and
    `initial`, which has (conv_id, shown, asked), see `walk_in_order`.
    """
    asks = F.col("role") == "user"
    tagged = tag_intent(turns.withColumn("_question", F.when(asks, F.col("text"))), rules, text="_question", into="_asked")
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in turns.columns else F.lit(False)
    weight = F.col("weight").cast("bigint") if "weight" in turns.columns else F.lit(1).cast("bigint")
    values = {
        "role": F.col("role"),
        "text": F.col("text"),
        "asked": F.when(asks, F.col("_asked")),
        "failed": failed,
        "hidden": is_hidden(turns),
        "weight": weight,
    }
    named = tagged.withColumn("turn", F.col("turn").cast("bigint"))
    walked = walk_in_order(named, TranscriptWalk(), TURN_KEY, time, ["turn"], values, delay, None, marks, initial)
    shown = attach_labels(walked.where(~F.col("hidden")), labels)
    return shown.select(TURN_KEY, "turn", *displayed(user, agent), "late")
