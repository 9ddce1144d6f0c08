"""The last stage of the pipeline tells what its tokenizer does otherwise and what does not come back."""

import corpus_pipeline
from colloquy.llm import sentencepiece_codec as codec


def test_tokens_are_verified_and_decoded(spark):
    texts = ["two  words\n", "", None, "a ▁ b", "é😀 漢字"]
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], "doc_id LONG, text STRING, lang STRING, source STRING")
    rows = sorted(corpus_pipeline.encoded(spark, docs, "").collect())
    assert [r["round_trip"] for r in rows] == [True, True, None, False, True]
    assert [r["n_differing"] for r in rows] == [0] * 5


def test_words_of_another_tokenizer_are_counted():
    model = corpus_pipeline.model_bytes()
    own = codec.Codec(model, verify=True)
    other = codec.parse(model)
    # No piece of more than two characters is ever made.
    short = [p if len(p.text) < 3 or p.kind != codec.NORMAL else p._replace(kind=codec.CONTROL) for p in other.pieces]
    own.tokenizer = codec.build(other._replace(pieces=tuple(short)))
    assert sum(own.encode_batch(["the tokenizer and the sentences of the others"])[1]) > 0
