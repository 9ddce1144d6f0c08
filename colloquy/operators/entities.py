"""Forecasts and positions of any number of entities, as maps.

With a handful of entities a column each is best; see `tagging`. With thousands, a message is looked through for the
names first, all at once by an automaton, and only those in it are read on; what is found is a map from entity to place.
"""

from __future__ import annotations

import uuid
from typing import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.rules import MODE_RULES, NO_FORECAST_TEXT, Rule, mode_text
from colloquy.functions.text import LINE_END, WHITESPACE
from colloquy.operators.session import heard_exchanges
from colloquy.operators.tagging import lowered_name, mode_signal, with_lowered
from colloquy.operators.turns import TURN_KEY, TURN_ORDER, is_hidden


NAMED = "array<struct<name: string, low: string>>"


def _named(messages: DataFrame, entities: Sequence[str], lowered: bool):
    """Function that gives the entities whose name, lower-cased or as it is, is in a text, in their order: one reading of the
    text, however many there are. Names that are equal lower-cased are found together."""
    if "" in entities or len(set(entities)) < len(entities):
        raise ValueError("entities must have names of their own")
    shared = messages.sparkSession.sparkContext.broadcast([(e, e.lower()) for e in entities])
    name = uuid.uuid4().hex

    def automaton():
        import ahocorasick

        # Kept at the library, which stays loaded in a worker, where a task may use two of them.
        kept = ahocorasick.__dict__.setdefault("_kept_entities", {})
        if name not in kept:
            ranks: dict[str, list[int]] = {}
            for rank, names in enumerate(shared.value):
                ranks.setdefault(names[lowered], []).append(rank)
            made = ahocorasick.Automaton()
            for word, found in ranks.items():
                made.add_word(word, found)
            if ranks:
                made.make_automaton()
            while len(kept) > 1:
                kept.pop(next(iter(kept)))
            kept[name] = made
        return kept[name]

    def find(texts: pd.Series) -> pd.Series:
        made, names, out = automaton(), shared.value, []
        for text in texts:
            ranks = {r for _, found in made.iter(text) for r in found} if text and len(made) else ()
            out.append([{"name": names[r][0], "low": names[r][1]} for r in sorted(ranks)])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(find, NAMED)


def _first_line(text: Column, name: Column, found) -> Column:
    """What the first line with a hit gives; empty when none does. A text of one line is not cut."""
    lines = F.filter(F.split(text, LINE_END), lambda line: F.contains(line, name))
    hits = F.filter(F.transform(lines, found), lambda x: x != "")
    return F.coalesce(F.when(text.rlike(LINE_END), F.get(hits, F.lit(0))).otherwise(found(text)), F.lit(""))


def _place_in_reply(reply: Column, name: Column) -> Column:
    def found(line: Column) -> Column:
        behind = F.substr(line, F.instr(line, name) + F.length(name))
        return F.regexp_extract(behind, "[Pp]([0-9]+)", 1)

    return _first_line(reply, name, found)


def _place_in_message(lowered: Column, low: Column) -> Column:
    """A number after the name, else marked digits before it on its line."""

    def found(line: Column) -> Column:
        behind = F.call_function("substring_index", line, low, F.lit(-1))
        before = F.left(line, F.length(line) - F.length(behind) - F.length(low))
        return F.regexp_extract(before, "[p#]([0-9]+)", 1)

    pattern = F.concat(F.lit("\\Q"), low, F.lit(rf"\E{WHITESPACE}*[p#]?([0-9]+)"))
    after = F.call_function("regexp_extract", lowered, pattern, F.lit(1))
    return F.when(after != "", after).otherwise(_first_line(lowered, low, found))


def _map_of(named: Column, text: Column, field: str, place) -> Column:
    placed = F.transform(named, lambda e: F.struct(e["name"].alias("key"), place(text, e[field]).alias("value")))
    hits = F.filter(placed, lambda x: x["value"] != "")
    return F.map_from_entries(F.transform(hits, lambda x: F.struct(x["key"], F.concat(F.lit("P"), x["value"]))))


def position_map(messages: DataFrame, entities: Sequence[str], text: str = "reply", into: str = "positions") -> DataFrame:
    """Replies with a map of the entities whose place they report; empty without any, null without a reply. Values are those
    of `extract_positions`."""
    named = messages.withColumn("_named", _named(messages, entities, lowered=False)(F.col(text)))
    return named.withColumn(into, _map_of(F.col("_named"), F.col(text), "name", _place_in_reply)).drop("_named")


def forecast_map(
    messages: DataFrame, entities: Sequence[str], least: int = 2, text: str = "message", into: str = "forecast"
) -> DataFrame:
    """Messages with a map of the places they foresee, null unless they place `least` entities. For two entities values
    are those of `extract_forecast`."""
    lowered = F.col(lowered_name(text))
    named = with_lowered(messages, text).withColumn("_named", _named(messages, entities, lowered=True)(lowered))
    found = named.withColumn(
        into, F.when(F.contains(lowered, F.lit("p")), _map_of(F.col("_named"), lowered, "low", _place_in_message))
    ).drop("_named")
    kept = found.withColumn(into, F.when(F.size(F.map_keys(into)) >= least, F.col(into)))
    return kept if lowered_name(text) in messages.columns else kept.drop(lowered_name(text))


def session_snapshot_by_map(
    exchanges: DataFrame,
    entities: Sequence[str],
    mode_rules: Sequence[Rule] = MODE_RULES,
    least: int = 2,
    key: str = TURN_KEY,
    order: Sequence[str] = TURN_ORDER,
) -> DataFrame:
    """One row per session: (key, mode, forecast, positions, messages, mode_text, forecast_text), with maps where
    `session_snapshot` has a column per entity.

    The first forecast counts as a whole, positions entity by entity. They are folded as rows (key, entity), combined
    before the shuffle, so a session of any length sends one row per entity and task; its map is as large as the number
    of entities.
    """
    heard = heard_exchanges(exchanges)
    told = position_map(forecast_map(mode_signal(with_lowered(heard), mode_rules), entities, least), entities)
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    shown = "shown" if "shown" in exchanges.columns else "answered"
    folded = told.groupBy(key).agg(
        F.min_by("mode", F.when(F.col("mode").isNotNull(), at)).alias("mode"),
        F.min_by("forecast", F.when(F.col("forecast").isNotNull(), at)).alias("forecast"),
        (F.count_if(~is_hidden(exchanges)) + F.count_if(shown)).alias("messages"),
    )
    places = told.select(key, *order, F.explode("positions").alias("_entity", "_place"))
    last = places.groupBy(key, "_entity").agg(F.max_by("_place", at).alias("_place"))
    maps = last.groupBy(F.col(key).alias("_key")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_entity", "_place")))).alias("positions")
    )
    joined = folded.join(maps, F.col(key).eqNullSafe(F.col("_key")), "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return joined.select(
        key,
        "mode",
        "forecast",
        F.coalesce("positions", none).alias("positions"),
        "messages",
        mode_text(F.col("mode")).alias("mode_text"),
        F.when(F.col("forecast").isNull(), NO_FORECAST_TEXT).alias("forecast_text"),
    )
