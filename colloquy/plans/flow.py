"""From response bodies to state, in one shuffle: what an exchange sent, got, said and left behind."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from colloquy.functions import signals
from colloquy.functions.rules import ENTITIES
from colloquy.operators.chunks import Chunks, Fold, measure, scan
from colloquy.operators.payloads import normalise_payloads, outcome_exchanges, request_records
from colloquy.operators.session import exchange_signals
from colloquy.operators.tagging import attach_labels, tag_intent
from colloquy.operators.turns import TURN_KEY, TURN_ORDER, is_hidden


def conversation_flow(
    sends: DataFrame, entities: Sequence[str] = ENTITIES, chunks: Chunks | None = None
) -> DataFrame:
    """Sends (conv_id, turn, message, body [, hidden]) with all that follows from them.

    Bodies give status, reply and the id they return, also where the reply is of the wrong type; ids are carried
    on to the next request, whose record is made with the id held by then, of the JSON type it came in; messages and replies are numbered,
    hidden messages not; and state runs on over answered exchanges. Everything carried is one scan over one
    shuffle.
    """
    chunks = chunks or measure(sends, TURN_KEY, TURN_ORDER)
    outcomes = outcome_exchanges(normalise_payloads(sends.withColumn("hidden", is_hidden(sends)), typed_ids=True))
    # Signals are of answered messages only, requests of all.
    tagged = tag_intent(outcomes).withColumn("_sent", F.col("message"))
    kept = ["intent", "_sent", "status", "conversation_id", "conversation_id_json"]
    told = exchange_signals(tagged, entities, order=[*TURN_ORDER, *kept])
    firsts = ["mode", *[signals.forecast_name(e) for e in entities]]
    lasts = [signals.position_name(e) for e in entities]
    carried = told.withColumns(
        {
            "_id": F.nullif("conversation_id", F.lit("")),
            "_weight": F.when(F.col("hidden"), 0).otherwise(1) + F.when(F.col("shown"), 1).otherwise(0),
        }
    )
    folds = {
        "request_id": Fold("last", "_id", current=False),
        "_request_json": Fold("last", "conversation_id_json", current=False),
        "session_id": Fold("last", "_id"),
        "_total": Fold("total", "_weight"),
        **{f"_after_{c}": Fold("first", c) for c in firsts},
        **{f"_after_{c}": Fold("last", c) for c in lasts},
    }
    after = scan(carried, chunks, folds)
    sent = request_records(after, "_sent", "_request_json", typed=True)
    reply_number = F.when(F.col("shown"), F.col("_total") - 1)
    asked = F.when(~F.col("hidden"), F.col("_total") - F.when(F.col("shown"), 2).otherwise(1))
    shown = sent.withColumn("intent", F.when(F.col("answered"), F.col("intent")))
    return attach_labels(shown).select(
        chunks.key,
        *chunks.order,
        "status",
        "request_id",
        "session_id",
        "record",
        asked.alias("number"),
        reply_number.alias("reply_number"),
        "label",
        *[F.col(f"_after_{c}").alias(c) for c in (*firsts, *lasts)],
    )
