"""Ids against the sentencepiece library, for the model as it is and for the same pieces as a unigram model."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from colloquy.llm import sentencepiece_codec as codec

DATA = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "  two  spaces   three    and more" + " " * 40 + "x", "line\nline\n\n\ttab",
    "é😀 漢字 \u0000 ▁ ▁▁x", "<s> </s> <unk> <0x0A>", "x" * 3000, "1234567890 3.14 +1 (2)", "ǅ ﬁ Å", "thndwh ononereth",
]


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def message(fields):
    """A protobuf message of (number, value) pairs."""
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def changed(kind=None, normaliser=None, scores=None):
    """The model with another kind, normaliser settings or scores."""
    fields = []
    for number, value in codec._fields(DATA):
        if number == 1 and scores:
            piece = list(codec._fields(value))
            text = dict(piece)[1].decode()
            if dict(piece).get(3, 1) == 1:
                piece = [(n, scores(text) if n == 2 else v) for n, v in piece]
            value = message(piece)
        if number == 2 and kind:
            value = message([(n, kind if n == 3 else v) for n, v in codec._fields(value)])
        if number == 3 and normaliser:
            value = message([(n, normaliser.get(n, v)) for n, v in codec._fields(value)])
        fields.append((number, value))
    return message(fields)


def unigram_score(text):
    # Scores that make sums of unlike cuts unlike.
    return -8.0 - 3.0 / len(text) - int(hashlib.md5(text.encode()).hexdigest()[:4], 16) / 16384


MODELS = {
    "bpe": DATA,
    "bpe without prefix": changed(normaliser={3: 0}),
    "bpe with spaces removed": changed(normaliser={4: 1}),
    "unigram": changed(kind=1, scores=unigram_score),
}


def random_texts(n):
    dice = random.Random(11)
    words = ["the", "of", "thndwh", "éelle", "Über", "x1", "<s>", "\n", "", "  ", "▁", "漢", "...", "ononereth"]
    return [" ".join(dice.choice(words) for _ in range(dice.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("name", MODELS)
def test_ids_equal_the_reference_library(name):
    theirs = sentencepiece.SentencePieceProcessor(model_proto=MODELS[name])
    own = codec.Codec(MODELS[name], verify=True)
    texts = TEXTS + random_texts(500)
    ids, differing = own.encode_batch(texts)
    for text, got, want in zip(texts, ids, theirs.encode(texts)):
        assert got.tolist() == want, text
    assert not any(differing)
    for text, got in zip(texts, ids):
        assert own.decode(got.tolist()) == theirs.decode(got.tolist()), text


def test_model_settings_are_read():
    model = codec.parse(DATA)
    assert (model.kind, model.byte_fallback, model.dummy_prefix, model.remove_extra_spaces) == (2, True, True, False)
    assert len(model.pieces) == 32_000
    with pytest.raises(ValueError):
        codec.parse(changed(kind=3))


def test_digests(awkward):
    docs = awkward(TEXTS)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = codec.encode_digests(docs, DATA).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = np.array(theirs.encode(texts[r["doc_id"]]), "<i4")
        assert r["n_tokens"] == len(want)
        assert r["tokens_sha256"] == hashlib.sha256(want.tobytes()).hexdigest()
        assert r["n_differing"] == 0
        assert r["round_trip"] == ("▁" not in texts[r["doc_id"]])


def test_tables_round_trip(spark):
    docs = spark.createDataFrame(
        [(i, t, "x") for i, t in enumerate([*TEXTS, None]) if t is None or "▁" not in t], "doc_id LONG, text STRING, tokens STRING"
    )
    back = codec.decode(codec.encode(docs, DATA, "doc_id"), DATA, "doc_id")
    assert {tuple(r) for r in back.collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}


def test_empty_table(no_documents):
    assert codec.encode_digests(no_documents, DATA).count() == 0
    assert codec.encode(no_documents, DATA, "doc_id").count() == 0
