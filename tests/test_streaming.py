import random
import shutil
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colloquy.operators.admission import admit_sends
from colloquy.operators.session import session_snapshot, session_state, stitch_ids
from colloquy.operators.transcript import transcript
from colloquy.operators.turns import pair_exchanges
from colloquy.plans import catalog
from colloquy.sources.shared import new_folder
from colloquy.sources.store import Store
from colloquy.sources.turns import stream_files
from colloquy.streaming.admission import AdmissionWalk, admission_state, admit_stream
from colloquy.streaming.ordered import PROVIDER, kept_state, rocksdb_state, waiting_rows
from colloquy.streaming.session import session_state_stream, stitch_ids_stream
from colloquy.streaming.snapshot import compact_snapshots, keep_snapshots, latest_snapshots
from colloquy.streaming.tags import tag_exchanges
from colloquy.streaming.transcript import transcript_stream
from colloquy.streaming.turns import pair_stream

PHRASES = ["at home", "circuit", "Albon P{n}, Sainz P{m}", "hello", "explain the pit", "Albon P{n}"]


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    right = right.select(*left.columns)
    assert left.count() == right.count() > 0
    assert left.exceptAll(right).isEmpty()


@pytest.fixture(scope="module")
def arriving(spark):
    """Exchanges in files whose order is not the order of the turns."""
    rng = random.Random(3)
    folder = new_folder(spark, "arriving")
    rows = [
        (
            0 if rng.random() < 0.4 else rng.randrange(1, 12),
            turn,
            rng.choice(PHRASES).format(n=rng.randrange(20), m=rng.randrange(20)),
            rng.choice(["ok", "Albon P3", "Sainz and Albon p{n}"]).format(n=turn),
            rng.random() < 0.8,
        )
        for turn in range(400)
    ]
    schema = "conv_id BIGINT, turn BIGINT, message STRING, reply STRING, answered BOOLEAN"
    for part in (rows[200:300], rows[:200], rows[300:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_tags(spark, arriving):
    table = spark.read.parquet(arriving)
    out = new_folder(spark, "tags")
    (
        tag_exchanges(stream_files(spark, arriving, table.schema, per_batch=1))
        .writeStream.option("checkpointLocation", new_folder(spark, "progress"))
        .trigger(availableNow=True)
        .start(out, format="parquet")
        .awaitTermination()
    )
    same(spark.read.parquet(out), tag_exchanges(table))


def test_snapshots(spark, arriving):
    table = spark.read.parquet(arriving)
    out, progress = new_folder(spark, "snapshots"), new_folder(spark, "progress")
    stream = stream_files(spark, arriving, table.schema, per_batch=1)

    def run(progress, **options):
        keep_snapshots(stream, out, progress, buckets=4, **options).trigger(availableNow=True).start().awaitTermination()

    run(progress)
    manifest = Store(spark, out).manifest()
    assert len(manifest["changes"]) > 1 and manifest["base"] is None
    same(latest_snapshots(spark, out), session_snapshot(table))
    # A new progress folder begins at batch 0 again; what it reads anew is the last word. The store is merged on the way.
    run(new_folder(spark, "progress"), changes=2)
    manifest = Store(spark, out).manifest()
    assert len(manifest["changes"]) < 2 and manifest["base"] and len(manifest["applied"]) == 2
    same(latest_snapshots(spark, out), session_snapshot(table))
    compact_snapshots(spark, out)
    assert not compact_snapshots(spark, out)
    same(latest_snapshots(spark, out), session_snapshot(table))


def test_a_new_run_outweighs_older_versions(spark):
    schema = "conv_id BIGINT, turn BIGINT, message STRING, reply STRING, answered BOOLEAN"
    folder, out = new_folder(spark, "arriving"), new_folder(spark, "snapshots")

    def run():
        stream = stream_files(spark, folder, schema, per_batch=1)
        keep_snapshots(stream, out, new_folder(spark, "progress")).trigger(
            availableNow=True
        ).start().awaitTermination()

    for turn in (1, 2):
        spark.createDataFrame([(1, turn, "hello", "ok", True)], schema).write.mode("append").parquet(folder)
    run()
    spark.createDataFrame([(1, 0, "at home", "ok", True)], schema).write.mode("append").parquet(folder)
    run()
    got = latest_snapshots(spark, out).first()
    assert (got["mode"], got["messages"]) == ("home", 6)


def test_a_stopped_stream_goes_on_with_its_store(spark):
    schema = "conv_id BIGINT, turn BIGINT, message STRING, reply STRING, answered BOOLEAN"
    folder, out, progress = (new_folder(spark, n) for n in ("arriving", "snapshots", "progress"))
    for turn in range(3):
        row = spark.createDataFrame([(turn % 2, turn, "hello", "ok", True)], schema)
        row.coalesce(1).write.mode("append").parquet(folder)
        stream = stream_files(spark, folder, schema, per_batch=1)
        query = keep_snapshots(stream, out, progress).trigger(availableNow=True).start()
        query.awaitTermination()
    assert Store(spark, out).manifest()["applied"] == {str(query.id): 2}
    assert {(r["conv_id"], r["messages"]) for r in latest_snapshots(spark, out).collect()} == {(0, 4), (1, 2)}


BASE = datetime(2024, 1, 1)
MARKS = "until TIMESTAMP"


class Log:
    """A log whose files arrive one by one, and the streams over it that are stopped and go on."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.folder, self.marks = new_folder(spark, "log"), new_folder(spark, "marks")
        self.out, self.progress = new_folder(spark, "out"), new_folder(spark, "progress")
        spark.createDataFrame([], MARKS).write.parquet(self.marks)

    def add(self, *files):
        for rows in files:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def run(self, job):
        stream = job(
            stream_files(self.spark, self.folder, self.schema, per_batch=1), stream_files(self.spark, self.marks, MARKS)
        )
        with rocksdb_state(self.spark):
            running = (
                stream.writeStream.option("checkpointLocation", self.progress)
                .trigger(availableNow=True)
                .start(self.out, format="parquet")
            )
        running.awaitTermination()
        return self.spark.read.schema(stream.schema).parquet(self.out)

    def killed(self, job, batches):
        """Stops the stream as soon as some micro-batches are through, whatever it is at."""
        stream = job(
            stream_files(self.spark, self.folder, self.schema, per_batch=1), stream_files(self.spark, self.marks, MARKS)
        )
        with rocksdb_state(self.spark):
            running = (
                stream.writeStream.option("checkpointLocation", self.progress)
                .trigger(processingTime="0 seconds")
                .start(self.out, format="parquet")
            )
        until = time.time() + 120
        while len(running.recentProgress) < batches and running.isActive and time.time() < until:
            time.sleep(0.05)
        running.stop()

    def run_to_end(self, job):
        """All files first: a mark says that nothing earlier will come."""
        self.run(job)
        self.spark.sql("SELECT TIMESTAMP '9000-01-01 00:00:00' AS until").write.mode("append").parquet(self.marks)
        return self.run(job)


def in_files(rows, seed, spread, size):
    """Rows in files, each at most `spread` places from its own."""
    dice = random.Random(seed)
    shuffled = [r for _, r in sorted(enumerate(rows), key=lambda p: p[0] + dice.random() * spread)]
    return [shuffled[i : i + size] for i in range(0, len(rows), size)]


SENDS = "id BIGINT, key STRING, start TIMESTAMP, end TIMESTAMP"


def made_sends(n=300):
    dice, at = random.Random(5), lambda s: BASE + timedelta(seconds=s)
    ends = (None if i == n - 10 else at(i // 2 + dice.randrange(9)) for i in range(n))
    return [(i, str(dice.randrange(4)), at(i // 2), end) for i, end in enumerate(ends)]


def test_admission_of_shuffled_files(spark):
    rows, log = made_sends(), Log(spark, SENDS)
    log.add(*in_files(rows, 1, 30, 60))
    job = lambda sends, marks: admit_stream(sends, delay="20 seconds", marks=marks)
    # What is out before the end is right already, and only the last rows are missing.
    table = spark.createDataFrame(rows, SENDS)
    want = {(r["id"], r["key"], r["admitted"]) for r in admit_sends(table).collect()}
    early = {(r["id"], r["key"], r["admitted"]) for r in log.run(job).collect()}
    assert 200 < len(early) < 300 and early < want
    got = log.run_to_end(job)
    assert got.where("late").count() == 0
    assert {(r["id"], r["key"], r["admitted"]) for r in got.collect()} == want


def test_late_sends_have_no_verdict(spark):
    log, at = Log(spark, SENDS), lambda s: BASE + timedelta(seconds=s)
    log.add([(1, "a", at(100), at(200)), (2, "b", at(10), at(20))], [(3, "a", at(0), at(500)), (4, "a", at(150), at(160))])
    log.add([(5, "b", at(141), at(142)), (6, "c", at(140), None)])
    rows = log.run_to_end(lambda sends, marks: admit_stream(sends, delay="10 seconds", marks=marks)).collect()
    assert {(r["id"], r["admitted"], r["late"]) for r in rows} == {
        (1, True, False),
        (2, True, False),
        (3, None, True),
        (4, False, False),
        (5, True, False),
        (6, True, False),
    }


def test_free_keys_are_forgotten(spark):
    log, at = Log(spark, SENDS), lambda s: BASE + timedelta(seconds=s)
    log.add([(1, "a", at(0), at(5)), (2, "b", at(0), None)], [(3, "c", at(1000), at(1001))], [(4, "c", at(2000), at(9000))])
    log.run(lambda sends, marks: admit_stream(sends))
    kept = kept_state(spark, log.progress, "key", AdmissionWalk()).collect()
    assert [r["key"] for r in kept] == ["b"]
    assert [r["order0"] for r in waiting_rows(spark, log.progress, "key").collect()] == [4]


def test_a_stream_goes_on_from_a_table_and_from_a_stream(spark):
    rows = made_sends()
    want = {(r["id"], r["admitted"]) for r in admit_sends(spark.createDataFrame(rows, SENDS)).collect()}
    first, second = Log(spark, SENDS), Log(spark, SENDS)
    table = admit_sends(spark.createDataFrame(rows[:100], SENDS))
    got = {(r["id"], r["admitted"]) for r in table.collect()}
    first.add(*in_files(rows[100:200], 2, 10, 20))
    out = first.run(lambda sends, marks: admit_stream(sends, delay="20 seconds", initial=admission_state(table)))
    got |= {(r["id"], r["admitted"]) for r in out.collect()}
    # The second stream takes over what the first remembers, and the rows that wait there.
    state = kept_state(spark, first.progress, "key", AdmissionWalk())
    waiting = {r["order0"] for r in waiting_rows(spark, first.progress, "key").collect()}
    assert waiting and state.count()
    second.add([r for r in rows if r[0] in waiting], *in_files(rows[200:], 3, 10, 50))
    out = second.run_to_end(lambda sends, marks: admit_stream(sends, delay="20 seconds", marks=marks, initial=state))
    assert got | {(r["id"], r["admitted"]) for r in out.collect()} == want


TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, said TIMESTAMP"


def test_pairs_of_shuffled_files(spark):
    dice, rows, log = random.Random(9), [], Log(spark, TURNS)
    for turn in range(240):
        role = dice.choice(["user", "user", "ai"])
        rows.append((dice.choice([1, 1, 2, 3, None]), turn, role, dice.choice(["x", "y", None]), BASE + timedelta(seconds=turn)))
    log.add(*in_files(rows, 4, 20, 40))
    got = log.run_to_end(lambda turns, marks: pair_stream(turns, "said", "30 seconds", marks=marks))
    assert got.where("late").isEmpty()
    same(got.drop("late"), pair_exchanges(spark.createDataFrame(rows, TURNS).drop("said")))


def test_a_silent_conversation_is_closed(spark):
    log, at = Log(spark, TURNS), lambda s: BASE + timedelta(seconds=s)
    log.add([(1, 0, "user", "a", at(0)), (2, 0, "user", "b", at(0))])
    log.add([(2, 1, "user", "c", at(100)), (3, 0, "user", "d", at(900))])
    log.add([(2, 2, "ai", "e", at(140)), (1, 1, "ai", "late", at(1)), (3, 1, "ai", "f", at(930))], [(4, 0, "ai", "g", at(2000))])
    got = log.run(lambda turns, marks: pair_stream(turns, "said", "800 seconds", silence=60_000_000))
    assert {tuple(r) for r in got.collect()} == {
        (1, 0, "a", None, False, False),
        (1, 1, None, "late", False, True),
        (2, 0, "b", None, False, False),
        (2, 1, "c", "e", True, False),
        (3, 0, "d", "f", True, False),
    }


def test_running_state_and_ids_of_shuffled_files(spark, arriving):
    rows = [
        (*r, BASE + timedelta(seconds=r["turn"]), ["", None, f"c{r['turn'] // 7}"][r["turn"] % 3])
        for r in sorted(spark.read.parquet(arriving).collect(), key=lambda r: r["turn"])
    ]
    schema = "conv_id BIGINT, turn BIGINT, message STRING, reply STRING, answered BOOLEAN, said TIMESTAMP, conversation_id STRING"
    table, states, ids = spark.createDataFrame(rows, schema), Log(spark, schema), Log(spark, schema)
    for log in (states, ids):
        log.add(*in_files(rows, 6, 40, 80))
        got = states.run_to_end(lambda said, marks: session_state_stream(said, "said", delay="1 minute", marks=marks))
    assert got.where("late").isEmpty()
    same(got.drop("late"), session_state(table))
    got = ids.run_to_end(lambda said, marks: stitch_ids_stream(said, "said", delay="1 minute", marks=marks))
    same(got.drop("late"), stitch_ids(table).select("conv_id", "turn", "request_id", "session_id"))


def test_transcripts_of_a_killed_stream(spark):
    dice, rows = random.Random(12), []
    for turn in range(200):
        role, text = dice.choice([("user", "What is <DRS>?"), ("user", "pit"), ("ai", "a & b"), ("ai", None)])
        row = (dice.choice([1, 1, 2, 3]), turn, role, text, dice.random() < 0.2, dice.random() < 0.2)
        rows.append((*row, BASE + timedelta(seconds=turn)))
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, failed BOOLEAN, hidden BOOLEAN, said TIMESTAMP"
    log = Log(spark, schema)
    log.add(*in_files(rows, 8, 20, 25))
    job = lambda turns, marks: transcript_stream(turns, "said", delay="30 seconds", marks=marks)
    for batches in (2, 1):
        log.killed(job, batches)
    got = log.run_to_end(job)
    assert got.where("late").isEmpty()
    same(got.drop("late"), transcript(spark.createDataFrame(rows, schema).drop("said")))


def test_settings_of_the_session_are_put_back(spark):
    before = spark.conf.get(PROVIDER, None)
    with pytest.raises(ZeroDivisionError), rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get(PROVIDER)
        1 / 0
    assert spark.conf.get(PROVIDER, None) == before


@pytest.mark.parametrize("parts", [0, 3])
def test_streams_read_a_table_that_is_a_file_or_a_folder(spark, tmp_path, parts):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    folder = tmp_path / "tables"
    folder.mkdir()
    if parts:
        given.repartition(parts).write.parquet(str(folder / "conversations.parquet"))
    else:
        shutil.copy("/root/testdata/sf0.001/conversations.parquet", folder / "conversations.parquet")
    # Another table of the folder is none of its business.
    given.withColumn("turn", F.col("turn") + 1_000_000).write.parquet(str(folder / "more_conversations.parquet"))
    for streamed, plain in (("streamed_turns", "turn_scan"), ("streamed_exchanges", "exchanges")):
        want = catalog.QUERIES[plain](spark, "/root/testdata/sf0.001")
        got = catalog.QUERIES[streamed](spark, str(folder)).select(*want.columns)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        assert want.count()
