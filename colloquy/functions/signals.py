"""Patterns of forecasts in user messages and of positions in replies."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, functions as F

from colloquy.functions.text import LINE_END, WHITESPACE


def _slug(entity: str) -> str:
    return re.sub(r"\W+", "_", entity.lower())


def forecast_name(entity: str) -> str:
    return f"forecast_{_slug(entity)}"


def position_name(entity: str) -> str:
    return f"position_{_slug(entity)}"


def check_entities(entities: Sequence[str]) -> None:
    """Entities name columns, so no two may give the same name."""
    names = [_slug(e) for e in entities]
    if len(set(names)) < len(names) or "" in entities:
        raise ValueError(f"entities without a column name of their own: {list(entities)}")


def lines_with(text: Column, name: str) -> Column:
    """Lines of a text that hold a name; null without any text."""
    return F.filter(F.split(text, LINE_END), lambda line: F.contains(line, F.lit(name)))


def _first_hit(text: Column, name: str, found) -> Column:
    """What the first line with a hit gives; empty when none does. A text of one line, as most are, is not cut."""
    hits = F.filter(F.transform(lines_with(text, name), found), lambda x: x != "")
    one = F.when(F.contains(text, F.lit(name)), found(text))
    return F.coalesce(F.when(text.rlike(LINE_END), F.get(hits, F.lit(0))).otherwise(one), F.lit(""))


def number_after(lowered: Column, entity: str) -> Column:
    """Digits after a name, with or without a mark; empty when there are none."""
    return F.regexp_extract(
        lowered, rf"{re.escape(entity.lower())}{WHITESPACE}*[p#]?([0-9]+)", 1
    )


def number_before(lowered: Column, entity: str) -> Column:
    """Marked digits before a name on its line; empty when there are none.

    A line is read up to the last name in it, where the first marked digits are what a pattern over the
    whole line would find; so each line is read once.
    """
    name = entity.lower()

    def found(line: Column) -> Column:
        behind = F.substring_index(line, name, -1)
        before = F.left(line, F.length(line) - F.length(behind) - len(name))
        return F.regexp_extract(before, "[p#]([0-9]+)", 1)

    return _first_hit(lowered, name, found)


def place_in_reply(reply: Column, entity: str) -> Column:
    """Digits of the first place after a name on its line, the name's case kept; else empty.

    What follows the first name of a line is read once.
    """

    def found(line: Column) -> Column:
        behind = F.substr(line, F.instr(line, F.lit(entity)) + len(entity))
        return F.regexp_extract(behind, "[Pp]([0-9]+)", 1)

    return _first_hit(reply, entity, found)
