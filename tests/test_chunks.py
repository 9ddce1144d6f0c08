"""Cutting a large key must not show in any result."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import chunks as chunking
from colloquy.operators.chunks import CHUNK, assign, measure
from colloquy.operators.session import conversation_snapshot, session_snapshot, session_state, stitch_ids
from colloquy.operators.transcript import transcript
from colloquy.operators.turns import clean_turns, number_messages, pair_exchanges, turn_chunks

TEXTS = [
    "watching at home",
    "circuit",
    "Albon P{n}, Sainz P{m}",
    "explain",
    "pit",
    " ",
    "hello <there>",
    "nothing",
]


def rows(null_key=False):
    rng = random.Random(11)
    for turn in range(1500):
        key = 0 if rng.random() < 0.5 else rng.randrange(1, 40)
        text = rng.choice(TEXTS).format(n=rng.randrange(30), m=rng.randrange(30))
        # Gaps in the turns, and stretches without any reply.
        role = "user" if turn % 500 < 150 else rng.choice(["user", "ai"])
        yield (None if null_key and key == 0 else key, turn * turn, role, text)


@pytest.fixture(scope="module", params=[False, True], ids=["key", "null key"])
def turns(spark, request):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    return spark.createDataFrame(list(rows(request.param)), schema).repartition(4)


@pytest.fixture(scope="module")
def cut(turns):
    return turn_chunks(turns, max_rows=50)


def same(left, right):
    assert left.columns == right.columns
    assert left.count() == right.count() > 0
    assert left.exceptAll(right).isEmpty()


def test_small_keys_are_not_cut(turns):
    assert turn_chunks(turns).bounds is None
    assert assign(turns, turn_chunks(turns)) is turns


def test_chunks_are_bounded(turns, cut):
    placed = assign(turns, cut).groupBy("conv_id", CHUNK).count()
    large = placed.where(F.col(CHUNK).isNotNull())
    assert large.count() == cut.longest > 8
    assert large.agg(F.max("count")).first()[0] < 200
    assert placed.agg(F.sum("count")).first()[0] == turns.count()
    # Chunks follow each other.
    spans = assign(turns, cut).where(F.col(CHUNK).isNotNull()).groupBy(CHUNK)
    ordered = spans.agg(F.min("turn").alias("a"), F.max("turn").alias("b")).orderBy(CHUNK).collect()
    assert all(x["b"] < y["a"] for x, y in zip(ordered, ordered[1:]))


def test_chunks_stay_small_however_many(turns):
    many = measure(turns, "conv_id", ("turn",), max_rows=10)
    assert many.size == many.bounds.count() > 60
    placed = assign(turns, many).groupBy("conv_id", CHUNK).count().where(F.col(CHUNK).isNotNull())
    assert placed.agg(F.max("count")).first()[0] < 60
    same(pair_exchanges(turns, many), pair_exchanges(turns))


def test_cuts_may_fall_anywhere(turns, monkeypatch):
    monkeypatch.setattr(chunking, "SAMPLE", 5)
    rough = turn_chunks(turns, max_rows=40)
    assert rough.size == rough.bounds.count() > 4
    same(number_messages(turns, rough), number_messages(turns))


def test_large_tables_of_cuts_are_joined_by_shuffle(turns, cut, monkeypatch):
    monkeypatch.setattr(chunking, "BROADCAST_ROWS", 0)
    same(number_messages(turns, cut), number_messages(turns))


def test_pairs(turns, cut):
    cleaned = clean_turns(turns)
    same(pair_exchanges(cleaned, cut), pair_exchanges(cleaned))


def test_numbers(turns, cut):
    same(number_messages(turns, cut), number_messages(turns))
    weighted = turns.withColumn("w", F.length("role") % 3)
    same(number_messages(weighted, cut, "w"), number_messages(weighted, None, "w"))


def test_state(turns, cut):
    exchanges = pair_exchanges(clean_turns(turns))
    same(session_state(exchanges, chunks=cut), session_state(exchanges))


def test_ids(turns, cut):
    exchanges = pair_exchanges(clean_turns(turns)).withColumn(
        "conversation_id", F.when(F.col("turn") % 5 == 0, F.substring("reply", 1, 1))
    )
    same(stitch_ids(exchanges, chunks=cut), stitch_ids(exchanges))


def test_transcript(turns, cut):
    same(transcript(turns, chunks=cut), transcript(turns))


def test_chunks_pass_from_job_to_job(turns, cut):
    placed = assign(turns, cut)
    exchanges = pair_exchanges(placed)
    assert CHUNK in exchanges.columns
    same(session_state(exchanges, chunks=cut).drop(CHUNK), session_state(pair_exchanges(turns)))


def test_snapshot_is_the_last_state(turns):
    exchanges = pair_exchanges(clean_turns(turns))
    state = session_state(exchanges)
    signals = [c for c in state.columns if c not in ("conv_id", "turn")]
    last = state.groupBy("conv_id").agg(F.max_by(F.struct(*signals), "turn").alias("s"))
    last = last.select("conv_id", "s.*").fillna("—", ["position_albon", "position_sainz"])
    same(last, session_snapshot(exchanges).select("conv_id", *signals))


def test_conversation_snapshot(turns, cut):
    cleaned = clean_turns(turns)
    same(conversation_snapshot(cleaned, chunks=cut), conversation_snapshot(cleaned))
    paired = session_snapshot(pair_exchanges(cleaned)).drop("messages")
    every = conversation_snapshot(cleaned).join(paired.select("conv_id").withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    same(every.select(paired.columns), paired)
    counted = cleaned.groupBy("conv_id").agg(F.count("*").alias("messages"))
    same(conversation_snapshot(cleaned).select("conv_id", "messages"), counted)


def test_transcript_has_every_turn(turns):
    assert transcript(turns).count() == turns.count()


def test_conversations_are_cut_by_bytes(spark, turns):
    # Few rows, of which some are long: by rows nothing is cut.
    long = turns.withColumn("text", F.when(F.col("turn") % 7 == 0, F.repeat("text", 200)).otherwise(F.col("text")))
    most = 20_000
    assert turn_chunks(long).bounds is None
    by_bytes = turn_chunks(long, max_bytes=most)
    weighed = assign(long, by_bytes).groupBy("conv_id", CHUNK).agg(F.sum(F.octet_length("text")).alias("n"), F.count("*"))
    cut = weighed.where(F.col(CHUNK).isNotNull()).collect()
    longest = long.agg(F.max(F.octet_length("text"))).first()[0]
    assert len(cut) > 5 and max(r["n"] for r in cut) < 3 * most + longest
    assert all(r["n"] <= most for r in weighed.where(F.col(CHUNK).isNull()).collect())
    for job in (transcript, lambda t, chunks=None: pair_exchanges(clean_turns(t), chunks)):
        same(job(long, chunks=by_bytes), job(long, chunks=turn_chunks(long)))
