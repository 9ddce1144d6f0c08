"""Session state and session ids after each exchange, as exchanges arrive."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from colloquy.functions import signals
from colloquy.functions.rules import ENTITIES, MODE_RULES, Rule
from colloquy.operators.session import exchange_signals
from colloquy.operators.turns import TURN_KEY, TURN_ORDER
from colloquy.streaming.ordered import Walk, walk_in_order


def _ordered(rows: DataFrame, order: Sequence[str]) -> str:
    return ", ".join(f"`{o}` {rows.schema[o].dataType.simpleString()}" for o in order)


class SignalWalk(Walk):
    """Remembers the first of some signals and the last of others."""

    def __init__(self, order: str, n_order: int, firsts: Sequence[str], lasts: Sequence[str]):
        self.state = ", ".join(f"`{c}` STRING" for c in (*firsts, *lasts))
        self.out = f"{order}, {self.state}"
        self.n_order, self.n_firsts, self.n = n_order, len(firsts), len(firsts) + len(lasts)

    def start(self) -> tuple:
        return (None,) * self.n

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        at, said = row[1 : 1 + self.n_order], row[1 + self.n_order :]
        firsts = (new if old is None else old for old, new in zip(state[: self.n_firsts], said))
        lasts = (old if new is None else new for old, new in zip(state[self.n_firsts :], said[self.n_firsts :]))
        state = (*firsts, *lasts)
        return state, [(*at, *state)]

    def late(self, row: tuple) -> tuple:
        return (*row[1 : 1 + self.n_order], *self.start())


def state_walk(exchanges: DataFrame, entities: Sequence[str] = ENTITIES, order: Sequence[str] = TURN_ORDER) -> SignalWalk:
    # The forecast columns of a message are all set or all null, so the first of each are of one message.
    firsts = ["mode", *[signals.forecast_name(e) for e in entities]]
    return SignalWalk(_ordered(exchanges, order), len(order), firsts, [signals.position_name(e) for e in entities])


def session_state_stream(
    exchanges: DataFrame,
    time: str,
    entities: Sequence[str] = ENTITIES,
    mode_rules: Sequence[Rule] = MODE_RULES,
    key: str = TURN_KEY,
    order: Sequence[str] = TURN_ORDER,
    delay: str = "0 seconds",
    silence: int | None = None,
    marks: DataFrame | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """(key, *order, mode, forecasts, positions, late): the state after each exchange of a stream, in append mode; it is
    that of `session_state` where `time` grows with the order.

    Texts are reduced to signals before they reach the state. Exchanges may arrive up to `delay` after later ones; one
    that comes after that goes out `late` without a state and adds nothing to it. The state of a session is kept for good,
    or until it has been silent for `silence` microseconds. `initial` is what a session begins with: (key, mode,
    forecasts, positions), such as the last rows of `session_state`.
    """
    told = exchange_signals(exchanges, entities, mode_rules, key, [*order, time])
    walk = state_walk(exchanges, entities, order)
    names = ["mode", *[signals.forecast_name(e) for e in entities], *[signals.position_name(e) for e in entities]]
    values = {n: F.col(n) for n in names}
    return walk_in_order(told, walk, key, time, order, values, delay, silence, marks, initial)


class IdWalk(Walk):
    """Remembers the last id that was returned."""

    state = "id STRING"

    def __init__(self, order: str, n_order: int):
        self.out = f"{order}, request_id STRING, session_id STRING"
        self.n_order = n_order

    def start(self) -> tuple:
        return (None,)

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        held = state[0] if row[-1] is None else row[-1]
        return (held,), [(*row[1 : 1 + self.n_order], state[0], held)]

    def late(self, row: tuple) -> tuple:
        return (*row[1 : 1 + self.n_order], None, None)


def stitch_ids_stream(
    exchanges: DataFrame,
    time: str,
    returned: str = "conversation_id",
    key: str = TURN_KEY,
    order: Sequence[str] = TURN_ORDER,
    delay: str = "0 seconds",
    silence: int | None = None,
    marks: DataFrame | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """(key, *order, request_id, session_id, late) for each exchange of a stream, in append mode; ids are those of
    `stitch_ids` where `time` grows with the order. Delay, silence, marks and initial are those of `session_state_stream`;
    `initial` has (key, id)."""
    walk = IdWalk(_ordered(exchanges, order), len(order))
    values = {"id": F.nullif(F.col(returned), F.lit(""))}
    return walk_in_order(exchanges, walk, key, time, order, values, delay, silence, marks, initial)
