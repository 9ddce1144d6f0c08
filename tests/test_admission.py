import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import admission, chunks
from colloquy.operators.admission import admit_sends

SCHEMA = "id BIGINT, key BIGINT, start BIGINT, end BIGINT"


def brute_force(rows):
    free, verdicts = {}, {}
    for id, key, start, end in sorted(rows, key=lambda r: (r[2], r[0])):
        admitted = start >= free.get(key, float("-inf"))
        verdicts[id] = admitted
        if admitted:
            free[key] = float("inf") if end is None else end
    return verdicts


def verdicts(df):
    return {r["id"]: r["admitted"] for r in df.select("id", "admitted").collect()}


def test_golden(spark):
    times = [(0, 10), (5, 8), (9, 30), (10, 20), (19, 25), (20, 21)]
    rows = [(i, 1, s, e) for i, (s, e) in enumerate(times)]
    got = verdicts(admit_sends(spark.createDataFrame(rows, SCHEMA)))
    assert [got[i] for i in range(6)] == [True, False, False, True, False, True]


def shape(name, n, rng):
    rows = []
    for i in range(n):
        key = None if name == "null key" and rng.random() < 0.5 else (
            0 if rng.random() < 0.6 else rng.randrange(1, 30)
        )
        start = {"dense": i // 4, "ties": i // 97, "parity": i, "long": i}.get(
            name, rng.randrange(4 * n)
        )
        length = {
            "parity": 2,
            "long": rng.randrange(n // 3),
            "ties": rng.choice([0, 0, 1, 2]),
            "negative": rng.randrange(-3, 9),
            "constant": 37,
        }.get(name, rng.randrange(40))
        end = None if name == "unfinished" and i == n // 2 else start + length
        rows.append((i, 0 if name == "parity" else key, start, end))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "name",
    ["random", "dense", "ties", "parity", "long", "negative", "constant", "unfinished", "null key"],
)
def test_split_key_equals_brute_force(spark, name):
    rows = shape(name, 1500, random.Random(name))
    sends = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = brute_force(rows)
    assert 0 < sum(expected.values()) < len(rows) or name == "random"
    assert verdicts(admit_sends(sends)) == expected
    assert verdicts(admit_sends(sends, max_rows=60)) == expected


@pytest.mark.parametrize("name", ["parity", "constant", "random"])
@pytest.mark.parametrize("links, unused", [(None, "_reachable"), (1, "_follower")], ids=["walk", "doubling"])
def test_links_are_followed_either_way(spark, monkeypatch, name, links, unused):
    monkeypatch.setattr(admission, unused, None)
    rows = shape(name, 1500, random.Random(name))
    got = verdicts(admit_sends(spark.createDataFrame(rows, SCHEMA), max_rows=60, max_links=links))
    assert got == brute_force(rows)


@pytest.mark.parametrize("links", [None, 1], ids=["walk", "doubling"])
def test_chunks_stay_whole_where_spark_splits_the_partitions_of_joins(spark, monkeypatch, links):
    prefix = "spark.sql.adaptive."
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        prefix + "advisoryPartitionSizeInBytes": "1k",
        prefix + "coalescePartitions.enabled": "false",
        prefix + "skewJoin.skewedPartitionThresholdInBytes": "1k",
        prefix + "skewJoin.skewedPartitionFactor": "1.01",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    rows = shape("random", 6000, random.Random(7))
    sends = spark.createDataFrame(rows, SCHEMA).repartition(8)
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        assert verdicts(admit_sends(sends, max_rows=500, max_links=links)) == brute_force(rows)
        # The entries are joined by shuffle as well.
        monkeypatch.setattr(chunks, "BROADCAST_ROWS", 0)
        assert verdicts(admit_sends(sends, max_rows=500, max_links=links)) == brute_force(rows)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_cut_key_takes_few_jobs(spark):
    sends = spark.createDataFrame(shape("random", 1500, random.Random(2)), SCHEMA)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("admission", "")
    try:
        admit_sends(sends, max_rows=60).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("admission")) < 50


def test_times_must_agree(spark):
    df = spark.sql("SELECT 1 AS id, 1 AS key, 1.5D AS start, 2.5D AS end")
    with pytest.raises(ValueError):
        admit_sends(df)


def test_times_and_payload_columns_survive(spark):
    df = spark.sql(
        "SELECT id, 'k' AS key, timestamp_ntz'2024-03-31 01:59:00' + make_interval(0,0,0,0,0,id) AS start,"
        " timestamp'2024-01-01 00:00:00' AS seen, concat('n', id) AS note FROM range(4)"
    ).withColumn("end", F.expr("start + interval 90 seconds"))
    got = admit_sends(df)
    assert got.columns == [*df.columns, "admitted"]
    assert got.drop("admitted").exceptAll(df).isEmpty()
    assert [r["admitted"] for r in got.orderBy("id").collect()] == [True, False, True, False]


def plain_with_forced(rows):
    """Verdicts by a timeline of starts and ends: an accepted start sets the flag, the end of any accepted send clears it."""
    out = {}
    for key in {r[1] for r in rows}:
        accepted, verdicts = [], {}
        for id, _, start, end, forced in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            busy = False
            if accepted:
                # Cleared by an end at or after the last accepted start, but not after now.
                last = accepted[-1][0]
                busy = not any(e is not None and last <= max(s, e) <= start for s, e in accepted)
                # An earlier send's end at the very time of the last start came before that start.
                own = [max(s, e) for s, e in accepted[:-1] if e is not None]
                final = accepted[-1]
                cleared = any(last < e <= start for e in own) or (
                    final[1] is not None and max(final[0], final[1]) <= start
                )
                busy = not cleared
            verdicts[id] = bool(forced) or not busy
            if verdicts[id]:
                accepted.append((start, end))
        out |= verdicts
    return out


@pytest.mark.parametrize("seed, max_rows", [(1, None), (4, 40), (5, 60)])
def test_forced_sends_equal_a_timeline(spark, seed, max_rows):
    dice, rows = random.Random(seed), []
    for i in range(260):
        start = i // 2 if seed != 5 else i * 3
        length = dice.choice([0, 1, 3, 9, 30, -2])
        end = None if dice.random() < 0.02 else start + length
        rows.append((i, dice.choice(["a", "a", "b", None]), start, end, dice.choice([None, False, False, False, True])))
    schema = "id BIGINT, key STRING, start BIGINT, end BIGINT, forced BOOLEAN"
    sends = spark.createDataFrame(rows, schema)
    got = {r["id"]: r["admitted"] for r in admit_sends(sends, max_rows=max_rows, forced="forced").collect()}
    assert got == plain_with_forced(rows)
    assert {True, False} == set(got.values())
    # Without forced sends it is the ordinary walk.
    free = sends.withColumn("forced", F.lit(False))
    want = {r["id"]: r["admitted"] for r in admit_sends(free).collect()}
    assert {r["id"]: r["admitted"] for r in admit_sends(free, max_rows=max_rows, forced="forced").collect()} == want


def test_rounds_of_forced_sends_do_not_grow_with_the_chunks(spark, monkeypatch):
    """Something is always out, and for longer than a chunk of five rows."""
    rows = [(i, "a", 2 * i, 2 * i + 31 + 7 * (i % 5), i % 11 == 0) for i in range(300)]
    sends = spark.createDataFrame(rows, "id BIGINT, key STRING, start BIGINT, end BIGINT, forced BOOLEAN")
    kept, checkpoint = [], type(sends).checkpoint
    monkeypatch.setattr(type(sends), "checkpoint", lambda self, *a: kept.append(1) or checkpoint(self, *a))
    got = {r["id"]: r["admitted"] for r in admit_sends(sends, max_rows=5, forced="forced").collect()}
    assert got == plain_with_forced(rows)
    assert 0 < sum(got.values()) < len(rows)
    assert len(kept) < 16
