"""Turns paired to exchanges as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.operators.turns import TURN_KEY
from colloquy.streaming.ordered import Walk, walk_in_order


class PairWalk(Walk):
    """Remembers the message that waits for the turn after it."""

    state = "turn BIGINT, message STRING"
    out = "turn BIGINT, message STRING, reply STRING, answered BOOLEAN"

    def start(self) -> tuple:
        return (None, None)

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        _, turn, role, text = row
        reply = text if role == "ai" else None
        said = [] if state[0] is None else [(*state, reply, reply is not None)]
        return (turn, text) if role == "user" else (None, None), said

    def late(self, row: tuple) -> tuple:
        _, turn, role, text = row
        return (turn, text, None, False) if role == "user" else (turn, None, text, False)

    def finish(self, state: tuple) -> list[tuple]:
        return [] if state[0] is None else [(*state, None, False)]

    def forgets(self, state: tuple, watermark: int) -> bool:
        return state[0] is None


def pair_stream(
    turns: DataFrame,
    time: str,
    delay: str = "0 seconds",
    silence: int = 3_600_000_000,
    marks: DataFrame | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """(conv_id, turn, message, reply, answered, late) for user turns of a stream of cleaned turns, in append mode; the
    exchanges are those of `pair_exchanges` where `time` grows with the turn.

    A message goes out when the turn after it has come, and unanswered when its conversation has been silent for
    `silence` microseconds, an hour by default. Turns may arrive up to `delay` after later ones; what comes after that
    goes out unpaired and `late`, a reply with a null message. Only messages that wait are remembered. For `marks` and
    `initial`, which has (conv_id, turn, message), see `walk_in_order`.
    """
    named = turns.withColumn("turn", F.col("turn").cast("bigint"))
    values = {"role": F.col("role"), "text": F.col("text")}
    return walk_in_order(named, PairWalk(), TURN_KEY, time, ["turn"], values, delay, silence, marks, initial)
