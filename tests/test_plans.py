"""Plans that the jobs are written for."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from colloquy.operators.admission import admit_sends
from colloquy.operators.chunks import measure
from colloquy.operators.session import conversation_snapshot, session_snapshot, session_state, stitch_ids
from colloquy.operators.tagging import tag_intent
from colloquy.operators.transcript import transcript
from colloquy.operators.turns import clean_turns, number_messages, pair_exchanges, turn_chunks
from colloquy.plans.derived import event_exchanges, event_sends, table
from colloquy.plans.report import conversation_report
from colloquy.sources.shared import new_folder
from colloquy.sources.turns import read_turns, write_by_conversation, write_transcript

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return len(re.findall(rf"[-: ]{node}\b", plan(df)))


@pytest.fixture(scope="module")
def turns(spark):
    return read_turns(spark, f"{FOLDER}/conversations.parquet")


def test_scan_is_pruned_and_filtered(turns):
    text = plan(turns.select("conv_id"))
    assert "PushedFilters: [In(role, [ai,assistant,user])]" in text
    assert "ReadSchema: struct<conv_id:bigint,role:string>" in text


def test_tagging_does_not_shuffle(turns):
    tagged = tag_intent(turns, text="text")
    assert count(tagged, "Exchange") == 0
    # Lower-cased once for all rules.
    assert len(re.findall(r"lower\(", plan(tagged))) == 1


@pytest.mark.parametrize("job", [conversation_report, transcript, number_messages])
def test_one_shuffle_by_conversation(turns, job):
    df = job(turns)
    assert count(df, "Exchange") == 1
    assert "Exchange hashpartitioning(conv_id" in plan(df)
    assert "Python" not in plan(df) and "MapIn" not in plan(df)


def test_jobs_of_a_session_share_their_shuffle_and_sort(turns):
    chunks = turn_chunks(turns)
    exchanges = pair_exchanges(clean_turns(turns), chunks)
    held = stitch_ids(exchanges.withColumn("conversation_id", F.lit("c")), chunks=chunks)
    for df in (session_state(held, chunks=chunks), session_snapshot(exchanges)):
        assert count(df, "Exchange") == 1
        assert count(df, "Sort") == 1


def test_texts_are_not_shuffled_for_the_state(spark):
    said = event_exchanges(table(spark, FOLDER, "events"))
    below = plan(session_state(said)).split("Exchange")[1].splitlines()[1]
    kept = re.findall(r"AS (\w+)#", below)
    assert "mode" in plan(session_state(said)) and not {"message", "reply"} & set(kept)


def test_snapshot_combines_before_its_shuffle(spark):
    text = plan(session_snapshot(event_exchanges(table(spark, FOLDER, "events"))))
    assert "partial_min_by" in text.split("Exchange")[1]


def test_admission_shuffles_and_sorts_once(spark):
    df = admit_sends(event_sends(table(spark, FOLDER, "events")))
    assert count(df, "Exchange") == 1 and count(df, "Sort") == 1


def test_conversation_snapshot_shuffles_signals_once(spark, turns):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = conversation_snapshot(clean_turns(turns))
        assert count(df, "Exchange") == 1 and count(df, "FileScan") == 1 and count(df, "SortMergeJoin") == 0
        below = plan(df).split("Exchange")[1].splitlines()[1]
        assert "text#" not in below
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("job", [number_messages, transcript, pair_exchanges, conversation_snapshot])
def test_cut_rows_are_read_and_shuffled_once(spark, turns, job):
    cut = turn_chunks(turns.withColumn("conv_id", F.col("conv_id") % 2), 10)
    assert cut.size > 3
    df = job(clean_turns(turns).withColumn("conv_id", F.col("conv_id") % 2), chunks=cut)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    rows = re.findall(r"[+:]- Exchange hashpartitioning\(conv_id#\d+L?, _chunk#\d+, \d+\), REPARTITION", text)
    assert len(rows) == 1
    assert len(re.findall(r"[-: ]ReusedExchange", text)) >= 1
    assert len(re.findall(r"[-: ]FileScan", text)) == 1


def test_cut_keys_are_spread(spark):
    said = event_exchanges(table(spark, FOLDER, "events"), "event_id % 2")
    cut = measure(said, "conv_id", ("turn",), 50)
    text = plan(session_state(said, chunks=cut))
    assert "hashpartitioning(conv_id" in text and "_chunk" in text
    # Cut points are broadcast, carried rows are joined as their size allows.
    assert text.count("BroadcastHashJoin") >= 2


def test_transcript_files_follow_the_shuffle(spark, turns):
    path = new_folder(spark, "transcript")
    write_transcript(transcript(turns), path)
    files = spark.read.parquet(path).select("bucket", F.input_file_name().alias("file"))
    per_bucket = files.groupBy("bucket").agg(F.countDistinct("file").alias("n"))
    assert per_bucket.agg(F.max("n")).first()[0] == 1
    rows = spark.read.parquet(path)
    assert rows.drop("bucket").exceptAll(transcript(turns).select(rows.drop("bucket").columns)).isEmpty()
    one = files.first()["file"]
    written = [(r["conv_id"], r["number"]) for r in spark.read.parquet(one).collect()]
    assert written == sorted(written)


def test_long_conversation_fills_several_files(spark):
    turns = spark.range(3000).select(
        F.lit(7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.lit("user").alias("role"),
        F.lit("x").alias("text"),
    )
    cut = turn_chunks(turns, max_rows=500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = new_folder(spark, "transcript")
        write_transcript(transcript(turns, chunks=cut), path, chunks=cut)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 2 and sum(r["count"] for r in files) == 3000


def test_turns_by_conversation_are_not_shuffled(spark, turns):
    name = f"turns_{uuid.uuid4().hex}"
    try:
        placed = write_by_conversation(turns, name, new_folder(spark, "placed"), buckets=5)
        jobs = {
            "pairs": lambda t: pair_exchanges(clean_turns(t)),
            "numbers": number_messages,
            "state": lambda t: session_state(pair_exchanges(clean_turns(t))),
            "ids": lambda t: stitch_ids(pair_exchanges(clean_turns(t)).withColumn("conversation_id", F.col("reply"))),
            "transcript": transcript,
            "snapshot": conversation_snapshot,
        }
        for what, job in jobs.items():
            df = job(placed)
            assert count(df, "Exchange") == 0, what
            assert df.exceptAll(job(turns)).isEmpty() and job(turns).exceptAll(df).isEmpty(), what
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
