"""Exchanges tagged as they arrive."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from colloquy.functions import signals
from colloquy.functions.rules import ENTITIES, INTENT_RULES, MODE_RULES, Rule
from colloquy.operators.session import exchange_signals
from colloquy.operators.tagging import tag_intent
from colloquy.operators.turns import TURN_KEY, TURN_ORDER


def tag_exchanges(
    exchanges: DataFrame,
    intent_rules: Sequence[Rule] = INTENT_RULES,
    mode_rules: Sequence[Rule] = MODE_RULES,
    entities: Sequence[str] = ENTITIES,
    key: str = TURN_KEY,
    order: Sequence[str] = TURN_ORDER,
) -> DataFrame:
    """Answered exchanges with intent, mode, forecast and positions.

    Keeps no state, so it is the same on a stream (append) and on a table.
    """
    tagged = tag_intent(exchanges.where("answered"), intent_rules)
    told = exchange_signals(tagged, entities, mode_rules, key, [*order, "intent"])
    return told.select(
        key,
        *order,
        "intent",
        "mode",
        *[signals.forecast_name(e) for e in entities],
        *[signals.position_name(e) for e in entities],
    )
