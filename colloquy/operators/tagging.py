"""Stateless facts per message: intent, label, audience mode, forecast, reported positions.

Each job is one pass without a shuffle and works on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from typing import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.functions import signals
from colloquy.functions.rules import (
    DEFAULT_INTENT,
    ENTITIES,
    INTENT_LABELS,
    INTENT_RULES,
    MODE_RULES,
    Rule,
    first_match,
)

def lowered_name(text: str) -> str:
    return f"_lowered_{text}"


def with_lowered(messages: DataFrame, text: str = "message") -> DataFrame:
    """Messages with a column of their text in lower case, for several of the jobs below to share. It is named
    after its source, so that a job on another text does not take it for its own."""
    if lowered_name(text) in messages.columns:
        return messages
    return messages.withColumn(lowered_name(text), F.lower(text))


def _dropped(result: DataFrame, given: DataFrame, text: str) -> DataFrame:
    name = lowered_name(text)
    return result if name in given.columns else result.drop(name)


def tag_intent(
    messages: DataFrame,
    rules: Sequence[Rule] = INTENT_RULES,
    default: str | None = DEFAULT_INTENT,
    text: str = "message",
    into: str = "intent",
    whole_words: bool = False,
) -> DataFrame:
    """Messages with the label of the first rule that matches, else `default`."""
    tagged = first_match(F.col(lowered_name(text)), rules, default, whole_words)
    return _dropped(with_lowered(messages, text).withColumn(into, tagged), messages, text)


def mode_signal(
    messages: DataFrame,
    rules: Sequence[Rule] = MODE_RULES,
    text: str = "message",
    into: str = "mode",
    whole_words: bool = False,
) -> DataFrame:
    """Messages with the audience mode they speak of, else null."""
    return tag_intent(messages, rules, None, text, into, whole_words)


def extract_forecast(
    messages: DataFrame, entities: Sequence[str] = ENTITIES, text: str = "message"
) -> DataFrame:
    """Messages with one `forecast_…` column per entity, all null unless all are named.

    A number after the name is tried before a marked number in front of it, and a message without the
    letter p is not read.
    """
    signals.check_entities(entities)
    lowered = F.col(lowered_name(text))
    worth_reading = F.contains(lowered, F.lit("p"))
    for entity in entities:
        worth_reading = worth_reading & F.contains(lowered, F.lit(entity.lower()))
    # Each pattern is a column of its own, so that it runs once and only where it is needed.
    steps = with_lowered(messages, text).withColumns(
        {
            f"_after{i}": F.when(worth_reading, signals.number_after(lowered, e)).otherwise("")
            for i, e in enumerate(entities)
        }
    )
    steps = steps.withColumns(
        {
            f"_place{i}": F.when(F.col(f"_after{i}") != "", F.col(f"_after{i}"))
            .when(worth_reading, signals.number_before(lowered, e))
            .otherwise("")
            for i, e in enumerate(entities)
        }
    )
    complete = F.lit(True)
    for i in range(len(entities)):
        complete = complete & (F.col(f"_place{i}") != "")
    places = {
        signals.forecast_name(e): F.when(complete, F.concat(F.lit("P"), F.col(f"_place{i}")))
        for i, e in enumerate(entities)
    }
    work = [f"_{step}{i}" for step in ("after", "place") for i in range(len(entities))]
    return _dropped(steps.withColumns(places).drop(*work), messages, text)


def extract_positions(
    messages: DataFrame, entities: Sequence[str] = ENTITIES, text: str = "reply"
) -> DataFrame:
    """Replies with one `position_…` column per entity, each found by itself."""
    signals.check_entities(entities)
    reply = F.col(text)
    found = messages.withColumns(
        {
            f"_place{i}": F.when(
                F.contains(reply, F.lit(e)), signals.place_in_reply(reply, e)
            ).otherwise("")
            for i, e in enumerate(entities)
        }
    )
    places = {
        signals.position_name(e): F.when(
            F.col(f"_place{i}") != "", F.concat(F.lit("P"), F.col(f"_place{i}"))
        )
        for i, e in enumerate(entities)
    }
    return found.withColumns(places).drop(*[f"_place{i}" for i in range(len(entities))])


def attach_labels(
    tagged: DataFrame,
    labels: Mapping[str, str | None] | DataFrame = INTENT_LABELS,
    intent: str = "intent",
    into: str = "label",
) -> DataFrame:
    """Rows with the display label of their intent; null where the intent has none.

    A mapping is written in the program, so it is small and broadcast. A DataFrame (intent, label) with
    one row per intent may be of any size and is joined as its measured size allows.
    """
    if isinstance(labels, DataFrame):
        table = labels.select(F.col("intent").alias("_intent"), F.col("label").alias(into))
    else:
        shown = {k: v for k, v in labels.items() if v}
        table = F.broadcast(
            tagged.sparkSession.createDataFrame(
                pa.table(
                    {
                        "_intent": pa.array(shown.keys(), pa.string()),
                        into: pa.array(shown.values(), pa.string()),
                    }
                )
            )
        )
    return tagged.join(table, tagged[intent] == table["_intent"], "left").drop("_intent")
