"""The table of latest rows: batches, merges, and writers side by side."""

import threading

import pytest
from pyspark.sql import functions as F

from colloquy.sources import store as module
from colloquy.sources.shared import new_folder
from colloquy.sources.store import Store


def rows_of(spark, **values):
    return spark.createDataFrame([(int(k[1:]), v) for k, v in values.items()], "id BIGINT, said STRING")


def shown(store):
    return {r["id"]: r["said"] for r in store.read("id").collect()}


@pytest.fixture
def store(spark):
    return Store(spark, new_folder(spark, "store"))


def test_later_rows_take_the_place_of_earlier_ones(spark, store):
    assert store.read("id") is None and not store.merge("id")
    assert store.append(rows_of(spark, k1="a", k2="b"), "id", "w", 0, buckets=3)
    assert store.append(rows_of(spark, k2="c", k3=None), "id", "w", 1)
    want = {1: "a", 2: "c", 3: None}
    assert shown(store) == want
    assert store.merge("id") and shown(store) == want
    # Another number of buckets does not matter to a table that is there.
    store.append(rows_of(spark, k1="d"), "id", "w", 2, buckets=7)
    assert shown(store) == want | {1: "d"}
    assert store.merge("id") and shown(store) == want | {1: "d"}
    assert store.manifest()["buckets"] == 3


def test_null_keys_are_a_key(spark, store):
    for batch, said in enumerate("ab"):
        store.append(spark.createDataFrame([(None, said)], "id BIGINT, said STRING"), "id", "w", batch)
        store.merge("id")
    assert shown(store) == {None: "b"}


def test_a_batch_counts_once(spark, store):
    assert store.append(rows_of(spark, k1="a"), "id", "w", 4)
    assert not store.append(rows_of(spark, k1="b"), "id", "w", 4)
    assert not store.append(rows_of(spark, k1="b"), "id", "w", 3)
    assert shown(store) == {1: "a"}
    assert store.append(rows_of(spark, k1="c"), "id", "other", 0)
    assert shown(store) == {1: "c"}


def test_a_merged_table_is_read_without_a_shuffle(spark, store):
    for batch in range(5):
        store.append(rows_of(spark, k1="a", k2=str(batch)), "id", "w", batch, buckets=2)
    store.merge("id")
    plan = store.read("id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    # One file per bucket.
    assert len(store.read("id").inputFiles()) == 2
    assert len([n for n in store._names("data") if n.startswith("base")]) == 1


def test_a_merge_that_fails_loses_nothing(spark, store, monkeypatch):
    for batch in range(3):
        store.append(rows_of(spark, k1=str(batch), k2="x"), "id", "w", batch)
    before = store.manifest()

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "_put", fails)
    with pytest.raises(RuntimeError):
        store.merge("id")
    monkeypatch.undo()
    assert store.manifest() == before and shown(store) == {1: "2", 2: "x"}
    left = [n for n in store._names("data") if n.startswith("base")]
    assert len(left) == 1
    # What it left behind goes once it is old enough.
    monkeypatch.setattr(module, "LEFT_BEHIND", -1)
    assert store.merge("id")
    assert left[0] not in store._names("data") and shown(store) == {1: "2", 2: "x"}


def test_readers_keep_their_files_until_the_merge_after(spark, store):
    store.append(rows_of(spark, k1="a", k2="b"), "id", "w", 0)
    store.merge("id")
    store.append(rows_of(spark, k1="c"), "id", "w", 1)
    reading = store.read("id")
    store.merge("id")
    assert {r["id"]: r["said"] for r in reading.collect()} == {1: "c", 2: "b"}


def test_writers_and_merges_side_by_side(spark, store):
    failed = []

    def write(name):
        try:
            for batch in range(4):
                store.append(rows_of(spark, k1=name, **{f"k{ord(name)}": str(batch)}), "id", name, batch, buckets=2)
        except Exception as error:
            failed.append(error)

    def merge():
        try:
            for _ in range(4):
                store.merge("id")
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in "abc"] + [threading.Thread(target=merge) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = shown(store)
    assert got.pop(1) in "abc" and got == {ord(n): "3" for n in "abc"}
    manifest = store.manifest()
    assert manifest["applied"] == {"a": 3, "b": 3, "c": 3}
    assert store.merge("id") or not manifest["changes"]
    assert shown(store).keys() == {1, *map(ord, "abc")}


def test_a_change_is_seen_whole(spark, store):
    store.append(spark.range(1000).select("id", F.lit("a").alias("said")), "id", "w", 0)
    seen = store.manifest()
    store.append(spark.range(1000).select("id", F.lit("b").alias("said")), "id", "w", 1)
    assert {r["said"] for r in store._latest(seen, "id").collect()} == {"a"}
    assert {r["said"] for r in store.read("id").collect()} == {"b"}
