"""Batches that go to workers are small, and what a task made for itself goes when it ends."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from colloquy.llm import batches, catalog
from colloquy.llm.sentencepiece_codec import Codec


def sizes(frame):
    def run(given):
        for b in given:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return [r["n"] for r in frame.mapInArrow(run, "n BIGINT").collect()]


def test_stages_send_few_rows(spark):
    docs = spark.range(0, 3500, 1, 1).selectExpr("id AS doc_id", "'mail a@b.cd' AS text")
    before = spark.conf.get(batches.BATCH_SETTING)
    try:
        spark.conf.set(batches.BATCH_SETTING, "10000")
        masked = corpus_pipeline.masked(spark, docs, "")
        assert {r["text"] for r in masked.collect()} == {"mail [EMAIL]"}
        found = sizes(docs)
        assert sum(found) == 3500 and max(found) <= batches.ROWS
        for given, want in (("300", "300"), ("0", "1000"), ("-1", "1000")):
            spark.conf.set(batches.BATCH_SETTING, given)
            batches.send_few_rows(spark)
            assert spark.conf.get(batches.BATCH_SETTING) == want
    finally:
        spark.conf.set(batches.BATCH_SETTING, before)


def test_many_rows_keeps_all_rows_in_order():
    given = [pa.record_batch([pa.array(range(i, i + 7))], ["x"]) for i in range(0, 70, 7)]
    for rows in (1, 7, 20, 1000):
        got = list(batches.many_rows(iter(given), rows))
        assert [x for b in got for x in b.column(0).to_pylist()] == list(range(70))
        assert all(b.num_rows >= rows for b in got[:-1])
    assert not list(batches.many_rows(iter([])))
    assert not list(batches.many_rows(iter([given[0].slice(0, 0)])))


def test_codec_forgets_words_and_encodes_alike():
    codec = Codec(catalog.model_bytes(), verify=True)
    texts = ["the same words again, the same words", "", None, "other words"]
    first, _ = codec.encode_batch(texts)
    assert codec.words
    codec.forget()
    assert not codec.words
    again, _ = codec.encode_batch(texts)
    assert all(a is b is None or np.array_equal(a, b) for a, b in zip(first, again))
