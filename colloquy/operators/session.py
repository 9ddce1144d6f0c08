"""State that a session builds up: running, final, and the session id it carries."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import signals
from colloquy.functions.rules import (
    ENTITIES,
    MODE_RULES,
    NO_FORECAST_TEXT,
    NO_POSITION_TEXT,
    Rule,
    mode_text,
)
from colloquy.operators.chunks import CHUNK, Chunks, Fold, measure, released, scan
from colloquy.operators.tagging import (
    extract_forecast,
    extract_positions,
    mode_signal,
    with_lowered,
)
from colloquy.operators.turns import TURN_KEY, TURN_ORDER, is_hidden


def heard_exchanges(exchanges: DataFrame) -> DataFrame:
    """Exchanges without the texts of those that were not answered, as they say nothing."""
    answered = F.col("answered")
    return exchanges.withColumns({c: F.when(answered, F.col(c)) for c in ("message", "reply")})


def exchange_signals(
    exchanges: DataFrame,
    entities: Sequence[str] = ENTITIES,
    mode_rules: Sequence[Rule] = MODE_RULES,
    key: str = TURN_KEY,
    order: Sequence[str] = TURN_ORDER,
) -> DataFrame:
    """What each answered exchange says by itself; texts are left behind here, before any shuffle."""
    moods = mode_signal(with_lowered(heard_exchanges(exchanges)), mode_rules)
    told = extract_positions(extract_forecast(moods, entities), entities)
    kept = [c for c in (CHUNK, "shown", "hidden") if c in exchanges.columns]
    return told.select(
        key,
        *order,
        "answered",
        "mode",
        *[signals.forecast_name(e) for e in entities],
        *[signals.position_name(e) for e in entities],
        *kept,
    )


def session_state(
    exchanges: DataFrame,
    entities: Sequence[str] = ENTITIES,
    mode_rules: Sequence[Rule] = MODE_RULES,
    key: str = TURN_KEY,
    order: Sequence[str] = TURN_ORDER,
    chunks: Chunks | None = None,
) -> DataFrame:
    """State after each exchange: first mode, first forecast, latest position of each entity.

    The forecast columns of a message are all set or all null, so taking the first non-null of each
    takes them from one message.
    """
    chunks = chunks or measure(exchanges, key, tuple(order))
    told = exchange_signals(exchanges, entities, mode_rules, key, order)
    firsts = ["mode", *[signals.forecast_name(e) for e in entities]]
    lasts = [signals.position_name(e) for e in entities]
    folds = {f"_after_{c}": Fold("first", c) for c in firsts}
    folds |= {f"_after_{c}": Fold("last", c) for c in lasts}
    running = scan(told, chunks, folds)
    kept = [c for c in (CHUNK,) if c in exchanges.columns]
    return running.select(
        key, *order, *[F.col(f"_after_{c}").alias(c) for c in (*firsts, *lasts)], *kept
    )


def snapshot_columns(entities: Sequence[str], at: Column, messages: Column) -> list[Column]:
    """Aggregates that fold the signals of a session; they need no order and combine map-side."""

    def chosen(pick, name):
        column = F.col(name)
        return pick(column, F.when(column.isNotNull(), at)).alias(name)

    return [
        chosen(F.min_by, "mode"),
        *[chosen(F.min_by, signals.forecast_name(e)) for e in entities],
        *[chosen(F.max_by, signals.position_name(e)) for e in entities],
        messages.alias("messages"),
    ]


def with_display(snapshot: DataFrame, entities: Sequence[str]) -> DataFrame:
    missing = F.col(signals.forecast_name(entities[0])).isNull() if entities else F.lit(True)
    return snapshot.withColumns(
        {
            "mode_text": mode_text(F.col("mode")),
            "forecast_text": F.when(missing, NO_FORECAST_TEXT),
            **{
                signals.position_name(e): F.coalesce(
                    F.col(signals.position_name(e)), F.lit(NO_POSITION_TEXT)
                )
                for e in entities
            },
        }
    )


def session_snapshot(
    exchanges: DataFrame,
    entities: Sequence[str] = ENTITIES,
    mode_rules: Sequence[Rule] = MODE_RULES,
    key: str = TURN_KEY,
    order: Sequence[str] = TURN_ORDER,
) -> DataFrame:
    """One row per session with its final state, the texts shown for it, and its message count.

    `forecast_text` is the placeholder shown while there is no forecast. An exchange counts one message, and
    one more when a reply was shown: by a boolean column `shown` if there is one, as in what
    `outcome_exchanges` gives, where a failure is shown too; else when it was answered. The message of an exchange
    with a true `hidden` is not counted.
    """
    told = exchange_signals(exchanges, entities, mode_rules, key, order)
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    shown = "shown" if "shown" in exchanges.columns else "answered"
    messages = F.count_if(~is_hidden(exchanges)) + F.count_if(shown)
    return with_display(told.groupBy(key).agg(*snapshot_columns(entities, at, messages)), entities)


def conversation_snapshot(
    turns: DataFrame,
    entities: Sequence[str] = ENTITIES,
    mode_rules: Sequence[Rule] = MODE_RULES,
    chunks: Chunks | None = None,
) -> DataFrame:
    """The snapshot of each conversation from its cleaned turns; every turn counts as a message but `hidden` ones.

    One scan and one shuffle: a turn is reduced to its signals first, which the window then keeps where a question
    has its reply next to it.
    """
    chunks = chunks or measure(turns, TURN_KEY, TURN_ORDER)
    asked = F.col("role") == "user"
    said = turns.withColumns(
        {"message": F.when(asked, F.col("text")), "reply": F.when(F.col("role") == "ai", F.col("text"))}
    )
    told = extract_positions(
        extract_forecast(mode_signal(with_lowered(said), mode_rules), entities), entities
    )
    firsts = ["mode", *[signals.forecast_name(e) for e in entities]]
    lasts = [signals.position_name(e) for e in entities]
    kept = [c for c in (CHUNK, "hidden") if c in turns.columns]
    slim = told.select(chunks.key, *chunks.order, "role", *firsts, *lasts, *kept)
    near = scan(slim, chunks, {"_next": Fold("lead", "role"), "_before": Fold("lag", "role")})
    answered = asked & (F.col("_next") == "ai")
    replies = (F.col("role") == "ai") & (F.col("_before") == "user")
    heard = near.withColumns(
        {c: F.when(answered, F.col(c)) for c in firsts} | {c: F.when(replies, F.col(c)) for c in lasts}
    )
    folded = heard.groupBy(chunks.key).agg(
        *snapshot_columns(entities, chunks.position, F.count_if(~is_hidden(turns)))
    )
    return with_display(folded, entities)


def stitch_ids(
    exchanges: DataFrame,
    returned: str = "conversation_id",
    key: str = TURN_KEY,
    order: Sequence[str] = TURN_ORDER,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Exchanges with the id their request carries (`request_id`) and the id held afterwards.

    An empty returned id counts as none.
    """
    chunks = chunks or measure(exchanges, key, tuple(order))
    known = exchanges.withColumn("_id", F.nullif(F.col(returned), F.lit("")))
    held = {
        "request_id": Fold("last", "_id", current=False),
        "session_id": Fold("last", "_id"),
    }
    return released(scan(known, chunks, held).drop("_id"), exchanges)
