"""The pipeline against plain Python on small tables, and each stage on awkward rows."""

import shutil

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import catalog, quality_model
from test_near_copies import plain_kept
from test_pii import plain as plain_spans

FOLDER = "/root/testdata/sf0.001"


def plain_mask(text):
    """Base kinds only, again and again, as the pipeline's mask does; the test tables have no other kinds."""
    while spans := plain_spans(text):
        out, at, i = [], 0, 0
        while i < len(spans):
            start, rank, end = spans[i]
            while i + 1 < len(spans) and spans[i + 1][0] < end:
                i += 1
                end = max(end, spans[i][2])
            out += [text[at:start], "[" + ("EMAIL", "IP", "CARD", "PHONE")[rank] + "]"]
            at, i = end, i + 1
        text = "".join(out) + text[at:]
    return text


def test_pipeline_equals_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality_model.fit(docs, labels, ~quality_model.held_out(F.col("id")))
    good = {r["doc_id"] for r in quality_model.score(docs, model, "doc_id").where("score >= 0.7").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    kept, pairs, _ = plain_kept(sorted(texts.items()))
    assert pairs
    texts = {i: texts[i] for i in kept}
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {i: plain_mask(t) for i, t in texts.items() if not any(x in t for x in items)}
    processor = sentencepiece.SentencePieceProcessor(model_proto=catalog.model_bytes())
    want = {i: processor.encode(t) for i, t in texts.items()}
    got = {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want
    assert 20 < len(want) < docs.count()


def test_stages_take_awkward_rows(spark, tmp_path):
    for table in ("labels", "benchmark"):
        shutil.copy(f"{FOLDER}/{table}.parquet", tmp_path / f"{table}.parquet")
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()
    rows = [tuple(r) for r in base]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None), (None, None, "en", "x", None), (None, "", "en", "x", 0)]
    rows += [(rows[5][0], "another text of the same id, and one that is long enough to be told apart.", "en", "x", 1)]
    docs = spark.createDataFrame(
        [(*r, "key", "row", 7) for r in rows],
        "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, key STRING, `row` STRING, fingerprint INT",
    )
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            path = str(tmp_path / f"{empty}-{number}")
            out.write.parquet(path)
            after = spark.read.parquet(path)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == docs.columns, name
            if empty:
                assert after.count() == 0
            now = after


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    other = " ".join(f"v{i}" for i in range(200))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "c"), (None, text, "d"), (3, other, "e"), (None, None, "f"), (None, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    got = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in got) == [(0, ""), (3, "v0"), (3, "w0")]
