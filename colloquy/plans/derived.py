"""Inputs that the given tables do not hold as such, derived from all of their rows.

The texts are SQL expressions that Spark and the checking engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions.rules import Rule

# Rules over the vocabulary of the given conversations, in which the default rules hardly match.
VOCABULARY_RULES = (
    Rule("ARTICLE", ("eau", "ung")),
    Rule("SUFFIX", ("tion", "ch")),
    Rule("WORD", ("the", "there")),
)

PLACES = "CAST(event_id % 20 + 1 AS STRING) AS place, CAST(event_id % 17 + 1 AS STRING) AS other"
MESSAGE = """CASE event_id % 11
    WHEN 0 THEN 'Watching the ' || event_type || ' from my sofa'
    WHEN 1 THEN 'At the CIRCUIT for ' || event_type
    WHEN 2 THEN 'Albon P' || place || ', Sainz P' || other
    WHEN 3 THEN 'I pick p' || place || ' for albon, #' || other || ' for sainz'
    WHEN 4 THEN 'What is a ' || event_type || '?'
    WHEN 5 THEN 'Should we pit after the ' || event_type
    WHEN 6 THEN 'History of every ' || event_type
    WHEN 7 THEN 'my guess: albon ' || place || ' sainz ' || other
    WHEN 8 THEN 'p' || place || chr(10) || 'albon #' || place || ' sainz'
    WHEN 9 THEN 'albon ' || place || ' sainz ' || other
    ELSE event_type END"""
REPLY = """CASE event_id % 7
    WHEN 0 THEN NULL
    WHEN 1 THEN 'Albon is P' || place
    WHEN 2 THEN 'Sainz P' || other || ', Albon P' || place
    WHEN 3 THEN 'Albon and Sainz both ' || event_type || ', Sainz P' || place
    WHEN 4 THEN 'Albon' || chr(10) || 'P' || place || ' sainz p1'
    WHEN 5 THEN 'Albon lap' || place || ' then Albon P' || other
    ELSE event_type END"""
SEND_END = "ts + CAST(floor(value) AS BIGINT) * INTERVAL '1' MINUTE"
# Sends that are not held back.
FORCED = "event_id % 11 = 0"
# A third of all events in one session.
HOT_SESSION = "CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END"
# A third of all conversations as one, its turns in the order of the conversations.
HOT_CONVERSATION = "CASE WHEN conv_id % 3 = 0 THEN -1 ELSE conv_id END"
HOT_TURN = "conv_id * 1000 + turn"
# White space in front of and behind user texts, and user texts of nothing else.
PADDED_TEXT = """CASE WHEN role = 'user' AND (conv_id + turn) % 13 = 5 THEN ' \u3000' || chr(10)
    WHEN (conv_id + turn) % 3 = 0 THEN chr(9) || '\u00a0' || text || '\u2003 ' || chr(13) || chr(10)
    ELSE text END"""
# `quoted` is the text as a JSON string.
BODY = """CASE (conv_id * 5 + turn) % 13
    WHEN 0 THEN '{"response":' || quoted || ',"conversationId":"c' || CAST(conv_id AS STRING) || '"}'
    WHEN 1 THEN '{"response":"","result":' || quoted || '}'
    WHEN 2 THEN '{"output":' || quoted || ',"other":[1,2]}'
    WHEN 3 THEN '{"response":0,"result":false,"output":' || quoted || '}'
    WHEN 4 THEN '{"response":null,"conversationId":""}'
    WHEN 5 THEN '{"response":' || CAST(turn + 1 AS STRING) || ',"output":' || quoted || '}'
    WHEN 6 THEN text
    WHEN 7 THEN 'null'
    WHEN 8 THEN '[' || quoted || ']'
    WHEN 9 THEN '{"response":' || quoted || '} and more'
    WHEN 10 THEN '{"response":{"a":' || quoted || '},"conversationId":"d' || CAST(turn AS STRING) || '"}'
    WHEN 11 THEN '{"response":0.0,"result":true}'
    ELSE quoted END"""
SENT_ID = """CASE turn % 3 WHEN 0 THEN 'c' || CAST(conv_id AS STRING) WHEN 1 THEN '' END"""


def event_exchanges(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Events as exchanges: the user is the conversation, the event its turn."""
    placed = events.selectExpr("event_id", "event_type", f"{key} AS conv_id", *PLACES.split(", "))
    said = placed.select(
        "conv_id",
        F.col("event_id").alias("turn"),
        F.expr(MESSAGE).alias("message"),
        F.expr(REPLY).alias("reply"),
    )
    return said.withColumn("answered", F.col("reply").isNotNull())


def event_sends(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Events as sends that stay pending for `value` minutes."""
    return events.select(
        F.col("event_id").alias("id"),
        F.expr(key).alias("key"),
        F.col("ts").alias("start"),
        F.expr(SEND_END).alias("end"),
        F.expr(FORCED).alias("forced"),
    )


def response_bodies(turns: DataFrame, *kept: str) -> DataFrame:
    """Turns with a response body of one of many shapes around their text."""
    named = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = named.substr(F.lit(6), F.length(named) - 6)
    return turns.withColumn("quoted", quoted).select(
        "conv_id", "turn", *kept, F.expr(BODY).alias("body")
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
