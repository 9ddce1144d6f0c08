"""Prioritised keyword rules, compiled to one CASE WHEN."""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import Column, functions as F

from colloquy.functions.text import any_of


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]


# Intents with their keywords, first matching rule wins.
INTENT_RULES = (
    Rule(
        "TERM_EXPLAIN",
        ("undercut", "overcut", "drs", "vsc", "graining", "delta", "what is", "explain"),
    ),
    Rule("STRATEGY", ("pit", "strategy", "tyre", "tire", "should williams")),
    Rule("HISTORY", ("history", "championship", "1992", "senna", "mansell")),
    Rule("PREDICTION", ("prediction", "my guess", "how am i")),
)
DEFAULT_INTENT = "GENERAL"

# What a reader sees for an intent.
INTENT_LABELS = {
    "TERM_EXPLAIN": "⚙ Terms Engine",
    "STRATEGY": "🏁 Strategy Engine",
    "HISTORY": "📖 History",
    "PREDICTION": "🎯 Prediction Tracker",
    "GENERAL": None,
}

# Where the audience is, first matching rule wins.
MODE_RULES = (
    Rule("home", ("home", "watching", "sofa")),
    Rule("trackside", ("circuit", "track", "there")),
)
# Texts shown for a mode; any other mode shows the second text.
HOME_TEXT = "🏠 Home Fan"
AWAY_TEXT = "🏟 Trackside"
NO_MODE_TEXT = "Awaiting Mode"
NO_FORECAST_TEXT = "Set during onboarding"
NO_POSITION_TEXT = "—"

# Whose forecasts and positions are looked for.
ENTITIES = ("Albon", "Sainz")


def first_match(
    lowered: Column, rules: Sequence[Rule], default: str | None = None, whole_words: bool = False
) -> Column:
    """Label of the first rule with a keyword in the lower-cased text, else `default`."""
    chosen = None
    for rule in rules:
        hit = any_of(lowered, rule.keywords, whole_words)
        chosen = F.when(hit, rule.label) if chosen is None else chosen.when(hit, rule.label)
    otherwise = F.lit(default).cast("string")
    return otherwise if chosen is None else chosen.otherwise(otherwise)


def mode_text(mode: Column) -> Column:
    return (
        F.when(mode.isNull(), NO_MODE_TEXT).when(mode == "home", HOME_TEXT).otherwise(AWAY_TEXT)
    )
