"""Jobs put together: what each user message is about and what was replied."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colloquy.operators.chunks import Chunks, released
from colloquy.operators.tagging import attach_labels, tag_intent
from colloquy.operators.turns import clean_turns, pair_exchanges, turn_chunks


def conversation_report(turns: DataFrame, chunks: Chunks | None = None) -> DataFrame:
    """User messages with intent, label and reply. One shuffle, by conversation."""
    chunks = chunks or turn_chunks(turns)
    exchanges = pair_exchanges(clean_turns(turns), chunks)
    return attach_labels(tag_intent(released(exchanges, turns)))
