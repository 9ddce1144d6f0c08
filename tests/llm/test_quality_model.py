"""The classifier on held-out labels, its parts against plain Python, and awkward tables."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import catalog, quality_model as model

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def scored(spark):
    rows = catalog.QUERIES["op5_quality_classifier"](spark, FOLDER).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    return rows, labels


def test_held_out_accuracy(scored):
    rows, labels = scored
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(judged) > 10
    assert sum(p == q for p, q in judged) >= 0.95 * len(judged)


def test_scores_and_held_out_rows(scored):
    rows, _ = scored
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    allowed = ~model.held_out(F.col("id"))
    small = model.Settings(buckets=512, size=16, rounds=30)
    turned = labels.withColumn(
        "quality", F.when(model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    one, two = (model.fit(docs, x, allowed, small) for x in (labels, turned))
    assert np.array_equal(one.vectors, two.vectors)
    assert all(np.array_equal(a, b) for a, b in zip(one.network, two.network))


def test_context_vectors_equal_plain_sums():
    s = model.Settings(buckets=64, size=8)
    texts = ["One two three two", "two é 3!!", ""]
    index, words = model.index_vectors(s), model._Words(s)
    want = np.zeros((64, 9))
    for text in texts:
        ids = [words.bucket(w.lower()) for w in model.TOKEN.findall(text)]
        for i, a in enumerate(ids):
            want[a, 8] += 1
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    want[a, :8] += index[ids[j]]
    assert np.allclose(model.contexts(iter(texts), s), want)


def test_pooling_is_a_mean_over_the_whole_text():
    s = model.Settings()
    vectors, words = model.word_vectors(np.zeros((s.buckets, s.size + 1), np.float32), s), model._Words(s)
    short, long = model.pool(["alpha beta gamma. ", "alpha beta gamma. " * 20_000], vectors, words)
    assert np.allclose(short[:-1], long[:-1], atol=1e-4)
    assert short[-1] < long[-1] < 1
    late = model.pool(["alpha beta gamma. " * 2000 + "XX !! " * 2000], vectors, words)[0]
    assert not np.allclose(late[:-1], long[:-1], atol=0.05)
    assert model.pool(["", None], vectors, words).any() == False  # noqa: E712


def test_temperature_makes_probabilities_of_logits():
    dice = np.random.default_rng(0)
    true = dice.normal(0, 2, 20_000)
    y = (dice.random(20_000) < 1 / (1 + np.exp(-true))).astype(int)
    assert abs(model._temperature(3 * true, y) - 3) < 0.4


def test_awkward_tables(spark, awkward, no_documents):
    docs = awkward(["plain words", "x" * 100_000, "a b c " * 50_000])
    none = spark.createDataFrame([], "doc_id LONG, quality INT")
    assert {r["score"] for r in model.score(docs, model.fit(docs, none), "doc_id").collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (1, 1), (None, 0), (2, 7), (2, None)], "doc_id LONG, quality INT")
    assert {r["score"] for r in model.score(docs, model.fit(docs, one), "doc_id").collect()} == {1.0}
    both = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id LONG, quality INT")
    fitted = model.fit(docs, both)
    got = model.score(docs, fitted, "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (0, None)}) == 1  # repeated texts
    assert model.score(no_documents, fitted, "doc_id").count() == 0
    assert model.fit(no_documents, both).network is None


def test_broadcasts_name_no_class_of_the_library(spark):
    import pickle
    import pickletools

    kept = []
    real = spark.sparkContext.broadcast
    network = model.fit_network(np.eye(65)[:9], np.arange(9) % 2, np.zeros(9, bool), model.Settings())
    docs = spark.createDataFrame([(1, "a word"), (2, ""), (3, "!!! 12"), (4, None)], "doc_id LONG, text STRING")
    spark.sparkContext.broadcast = lambda value: kept.append(value) or real(value)
    try:
        vectors = np.zeros((model.Settings().buckets, 64), np.float32)
        scored = model.score(docs, model.Model(vectors, network, 0.5, model.Settings()), "doc_id").collect()
    finally:
        del spark.sparkContext.broadcast
    names = [str(a) for op, a, _ in pickletools.genops(pickle.dumps(kept[0])) if a is not None]
    assert kept and not any("colloquy" in n for n in names)
    # A text without a letter has no quality.
    assert [r["score"] > 0 for r in sorted(scored)] == [True, False, False, False]


def test_rows_of_one_id_are_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(i % 3, f"good text {i % 7}") for i in range(300)], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id LONG, quality INT")
    seen = []
    real = model.fit_network
    model.fit_network = lambda x, y, c, s: seen.append(len(y)) or real(x, y, c, s)
    try:
        model.fit(docs, labels)
    finally:
        model.fit_network = real
    assert seen == [3]
