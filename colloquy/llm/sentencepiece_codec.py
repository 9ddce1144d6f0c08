"""SentencePiece models run by the tokenizers library.

The model file is a protobuf; its pieces, normaliser settings and byte fallback are read from it and rebuilt: a
unigram model with its scores, a BPE model with merges that follow from the scores. Texts are normalised, cut at
the metaspace marker where no piece can reach across, and the distinct words of a batch are encoded together on
all threads of a task. Every newly encoded word can be checked against the sentencepiece library.

Defined results: a null text is encoded as null in `encode` and as an empty text in `encode_digests`; an empty text
has no ids; equal rows get equal ids; an empty table gives an empty result; columns that are not named are ignored.
Models with user-defined symbols or with the marker behind words are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from colloquy.llm.batches import few_rows, give_back

MARK = "▁"
# Numbers of the model format, as in its public schema.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
# Words kept with their ids between batches, and the longest one kept.
CACHED_WORDS = 250_000
CACHED_CHARS = 64
# Threads of the libraries in one task.
THREADS = 4
# Words encoded in one call: the library keeps far more than ids of each until they are read.
ENCODED_TOGETHER = 8192


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


class Model(NamedTuple):
    pieces: tuple[Piece, ...]
    kind: int
    byte_fallback: bool
    char_map: bytes
    dummy_prefix: bool
    remove_extra_spaces: bool
    escape_spaces: bool


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif wire == 5:
            yield key >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        elif wire == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        else:
            raise ValueError(f"not a model: wire type {wire}")


def parse(data: bytes) -> Model:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(Piece(piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    if trainer.get(24, 0):
        raise ValueError("the marker stands behind words")
    if any(p.kind == USER_DEFINED for p in pieces):
        raise ValueError("the model has user-defined symbols")
    return Model(
        tuple(pieces),
        kind,
        bool(trainer.get(35, 0)),
        normaliser.get(2, b""),
        bool(normaliser.get(3, 1)),
        bool(normaliser.get(4, 1)),
        bool(normaliser.get(5, 1)),
    )


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best score first; of equal scores, the earlier piece first."""
    scores = {p.text: p.score for p in model.pieces if p.kind == NORMAL}
    found = []
    for rank, piece in enumerate(model.pieces):
        if piece.kind == NORMAL:
            for cut in range(1, len(piece.text)):
                left, right = piece.text[:cut], piece.text[cut:]
                if left in scores and right in scores:
                    found.append((-piece.score, rank, cut, left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: Model):
    """The tokenizer of the library, without normaliser: it takes normalised words."""
    from tokenizers import Tokenizer, models

    unknown = next(i for i, p in enumerate(model.pieces) if p.kind == UNKNOWN)
    if model.kind == UNIGRAM:
        lowest = min((p.score for p in model.pieces if p.kind == NORMAL), default=0.0) - 10
        # Control pieces and bytes never come from text by themselves.
        scored = [(p.text, p.score if p.kind == NORMAL else lowest - 1e6) for p in model.pieces]
        return Tokenizer(models.Unigram(scored, unknown, model.byte_fallback))
    ids = {p.text: i for i, p in enumerate(model.pieces)}
    return Tokenizer(
        models.BPE(
            vocab=ids,
            merges=_merges(model),
            unk_token=model.pieces[unknown].text,
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    )


class Codec:
    """Encodes and decodes texts; lives in one task."""

    def __init__(self, data: bytes, verify: bool = False):
        self.model = parse(data)
        self.tokenizer = build(self.model)
        # Ids of each word, four bytes each.
        self.words: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.reference = None
        if verify:
            from sentencepiece import SentencePieceProcessor

            self.reference = SentencePieceProcessor(model_proto=data)
        self.char_map = None
        if self.model.char_map:
            from tokenizers import normalizers

            self.char_map = normalizers.Precompiled(self.model.char_map)
        inner = any(re.search(f"[^{MARK}]{MARK}", p.text) for p in self.model.pieces)
        self.cuts = not inner and any(p.text == MARK and p.kind == NORMAL for p in self.model.pieces)
        self.bytes = [
            bytes([int(p.text[3:5], 16)]) if p.kind == BYTE
            else b"" if p.kind == CONTROL
            else " ⁇ ".encode() if p.kind == UNKNOWN
            else p.text.replace(MARK, " ").encode()
            for p in self.model.pieces
        ]

    def normalise(self, text: str) -> str:
        if self.char_map is not None:
            text = self.char_map.normalize_str(text)
        if self.model.remove_extra_spaces:
            # At the end the marker itself counts as a space.
            text = " ".join(x for x in text.split(" ") if x).rstrip(f" {MARK}")
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape_spaces else text

    def split(self, normal: str) -> list[str]:
        """Words that no piece reaches across, each with the markers before it."""
        if not normal:
            return []
        if not self.cuts:
            return [normal]
        if normal[0] == MARK and MARK * 2 not in normal and normal[-1] != MARK:
            return [MARK + w for w in normal[1:].split(MARK)]
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", normal)

    def learn(self, words: set[str]) -> list[str]:
        """Encodes words that are not known yet, in few calls on several threads; returns those not to be kept."""
        if len(self.words) > CACHED_WORDS:
            # The older half goes; what is common comes back soon.
            self.words = dict(islice(self.words.items(), len(self.words) // 2, None))
        new = [w for w in words if w not in self.words]
        encoded: list[bytes] = []
        for at in range(0, len(new), ENCODED_TOGETHER):
            part = self.tokenizer.encode_batch_fast(new[at : at + ENCODED_TOGETHER], add_special_tokens=False)
            encoded += [array("i", e.ids).tobytes() for e in part]
        self.words.update(zip(new, encoded))
        if self.reference is not None and new:
            self._compare(new, encoded)
        return [w for w in new if len(w) > CACHED_CHARS]

    def forget(self) -> None:
        """Lets the known words of a task go: the worker that keeps the codec does other work too."""
        self.words.clear()
        self.differ.clear()
        give_back()

    def _compare(self, words: list[str], encoded: list[bytes]) -> None:
        """Notes the words that the reference library encodes otherwise."""
        plain = [w.replace(MARK, " ") if self.model.escape_spaces else w for w in words]
        cut = self.model.dummy_prefix
        # The reference normalises what it gets, so it is asked only where that gives the word back.
        asked = [i for i, w in enumerate(words) if self.normalise(plain[i][1:] if cut else plain[i]) == w]
        theirs = self.reference.encode([plain[i][1:] if cut else plain[i] for i in asked], num_threads=THREADS)
        for i, ids in zip(asked, theirs):
            if array("i", ids).tobytes() != encoded[i]:
                self.differ.add(words[i])

    def encode_batch(self, texts: list[str | None]) -> tuple[list[np.ndarray | None], list[int]]:
        """Ids of each text, and how many of its words the reference encodes otherwise."""
        split = [None if t is None else self.split(self.normalise(t)) for t in texts]
        self.differ.clear()
        long = self.learn(set(chain.from_iterable(w for w in split if w)))
        get = self.words.__getitem__
        ids = [None if w is None else np.frombuffer(b"".join(map(get, w)), np.int32) for w in split]
        bad = [sum(w in self.differ for w in words or ()) if self.differ else 0 for words in split]
        for word in chain(long, self.differ):
            self.words.pop(word, None)
        return ids, bad

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def codec_of(data: bytes, verify: bool = False) -> Codec:
    """The codec of a model, kept from task to task: what the library holds for one is not all given back.

    It is kept at the library, which stays loaded in a worker; this module travels with each task.
    """
    import tokenizers

    kept = getattr(tokenizers, "_kept_codec", None)
    if kept is None or kept[0] != (data, verify):
        kept = (data, verify), Codec(data, verify)
        tokenizers._kept_codec = kept
    return kept[1]


ENCODED = T.ArrayType(T.IntegerType())


def encode(
    texts: DataFrame, model: bytes, *keep: str, text: str = "text", into: str = "tokens", verify: bool = False
) -> DataFrame:
    """(kept columns, ids of the text), and with `verify` the n_differing and round_trip of `encode_digests`."""
    n = len(keep)
    given = text in keep
    read = texts.select(*keep, *([] if given else [F.col(text).cast("string").alias("_t")]))
    at = keep.index(text) if given else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, verify)
        for batch in _slices(batches):
            given = batch.column(at).to_pylist()
            ids, bad = codec.encode_batch(given)
            columns = [pa.array(ids, pa.list_(pa.int32()))]
            if verify:
                back = [None if i is None else codec.decode(i.tolist()) == x for i, x in zip(ids, given)]
                columns += [pa.array(bad, pa.int64()), pa.array(back, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names)
        codec.forget()

    schema = T.StructType([*read.schema[:n], T.StructField(into, ENCODED)])
    if verify:
        schema = schema.add("n_differing", T.LongType()).add("round_trip", T.BooleanType())
    names = schema.names
    return read.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: bytes, *keep: str, column: str = "tokens", into: str = "text") -> DataFrame:
    """(kept columns, text of the ids); null ids give a null text."""
    read = tokens.select(*keep, F.col(column).alias("_t"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in few_rows(batches, 250):
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*keep, into])

    return read.mapInArrow(run, T.StructType([*read.schema[:n], T.StructField(into, T.StringType())]))


def encode_digests(texts: DataFrame, model: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, tokens_sha256 of the ids as 32-bit little-endian numbers, round_trip, n_differing).

    `round_trip` tells whether decoding the ids gives the text back, `n_differing` how many of its words the
    sentencepiece library encodes otherwise.
    """
    read = texts.select(id, F.col(text).cast("string").alias("_t"))
    schema = T.StructType(
        [
            read.schema[0],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("tokens_sha256", T.StringType()),
            T.StructField("round_trip", T.BooleanType()),
            T.StructField("n_differing", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, verify=True)
        for batch in _slices(batches):
            given = [t or "" for t in batch.column(1).to_pylist()]
            ids, bad = codec.encode_batch(given)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([codec.decode(i.tolist()) == t for i, t in zip(ids, given)], pa.bool_()),
                    pa.array(bad, pa.int64()),
                ],
                [id, *schema.names[1:]],
            )
        codec.forget()

    return read.mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches, since ids take several times the room of their text. Threads of the library are switched
    on: a worker process has not used it before."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return few_rows(batches, 250)
