"""A learned quality score: random-indexing word vectors, pooled per document, and a small network on top.

Every word falls into one of `buckets` by its hash and has a fixed sparse vector of -1, 0 and 1. Over the training
texts, a word's context vector adds up the sparse vectors of the words around it; sparse and context vector
together are its word vector. A document is the mean over its words, the form of a word (upper case,
digits, signs) and its return (as the word before, on a line seen before) counting as words of their own. A network of
two layers in numpy is fitted to that, and a temperature, fitted on rows that the network was not,
makes probabilities of its outputs.

Fitting takes at most `rows` labelled rows, picked by the hash of their id, and leaves out whole texts for the
driver: tasks send it context vectors and pooled vectors of fixed size. Scoring reads every text whole.

Defined results: a null text is empty, and an empty text is scored as the mean text; rows are
scored one by one, so repeated rows get equal scores; labels other than 0 and 1 and rows without an id teach nothing;
with one kind of label only, or none, every score is its share (0.5 with none); an empty table gives an empty result;
only the id and the text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from colloquy.llm.batches import few_rows
from colloquy.sources.shared import new_folder

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
# Words of the form and the return of words; none of them can be in a text.
UPPER, TITLE, LOWER, DIGITS, SIGNS, AGAIN, LINE_AGAIN, LONG = (f"\x00{i}" for i in range(8))

# Words of which half the say of a text is taken from the mean text.
FEW = 20


class Settings(NamedTuple):
    buckets: int = 1 << 14
    size: int = 64
    ones: int = 4
    window: int = 2
    context: float = 0.5
    rows: int = 8192
    hidden: int = 32
    rounds: int = 400
    rate: float = 0.01
    decay: float = 1e-3
    seed: int = 7


class Network(NamedTuple):
    """Weights of the two layers, the temperature, and the centre and spread of its inputs."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float
    mean: np.ndarray
    spread: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Pooled vectors about their centre, drawn towards it where few words say little; the last column of `x`
        is how much they say."""
        return (x[:, :-1] - self.mean) / self.spread * x[:, -1:]

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(self.inputs(x) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


class Model(NamedTuple):
    vectors: np.ndarray
    network: Network | None
    share: float
    settings: Settings


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def index_vectors(s: Settings) -> np.ndarray:
    """The sparse vector of each bucket."""
    dice = np.random.default_rng(s.seed)
    out = np.zeros((s.buckets, s.size), np.float32)
    for i in range(s.ones):
        # Signs in turn, at any places: one that meets another adds to it.
        np.add.at(out, (np.arange(s.buckets), dice.integers(0, s.size, s.buckets)), 1.0 if i % 2 else -1.0)
    return out


class _Words:
    """Buckets of words and of their forms, remembered for the words seen so far."""

    def __init__(self, s: Settings):
        self.buckets = s.buckets
        self.known: dict[str, tuple[int, int]] = {}

    def bucket(self, word: str) -> int:
        return crc32(word.encode()) % self.buckets

    def look_up(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            if word[0].isalpha():
                form = UPPER if len(word) > 1 and word.isupper() else TITLE if word[0].isupper() else LOWER
            else:
                form = DIGITS if word[0].isdigit() else SIGNS
            found = self.known[word] = (self.bucket(word.lower()), self.bucket(form))
        return found

    def returns(self, words: list[str], text: str) -> tuple[int, int]:
        """How many words repeat the one before, and how many stand on lines seen before."""
        again = sum(a == b for a, b in zip(words, words[1:]))
        lines = [x for x in text.split("\n") if x]
        seen = len(lines) - len(set(lines))
        return again, round(len(words) * seen / len(lines)) if seen else 0


def pool(texts: list[str | None], vectors: np.ndarray, words: _Words) -> np.ndarray:
    """Mean word vector of each text, and in a last column n / (n + FEW) for its n words."""
    out = np.zeros((len(texts), vectors.shape[1] + 1), np.float32)
    returning = words.bucket(AGAIN), words.bucket(LINE_AGAIN), words.bucket(LONG)
    for i, text in enumerate(texts):
        found = TOKEN.findall(text) if text else []
        if not found:
            continue
        counted = Counter(found)
        pairs = [words.look_up(w) for w in counted]
        times = np.fromiter(counted.values(), np.float32, len(counted))
        ids = np.array(pairs, np.int64)
        total = times @ vectors[ids[:, 0]]
        forms = np.bincount(ids[:, 1], weights=times)
        used = np.flatnonzero(forms)
        total += forms[used].astype(np.float32) @ vectors[used]
        again, on_lines = words.returns(found, text)
        long = sum(n for w, n in counted.items() if len(w) > 20)
        total += again * vectors[returning[0]] + on_lines * vectors[returning[1]] + long * vectors[returning[2]]
        out[i, :-1] = total / len(found)
        out[i, -1] = len(found) / (len(found) + FEW)
    return out


def contexts(texts: Iterator[str], s: Settings) -> np.ndarray:
    """Sum, per bucket, of the sparse vectors around its words, and in a last column how often it occurs."""
    index = index_vectors(s)
    words = _Words(s)
    out = np.zeros((s.buckets, s.size + 1), np.float32)
    for text in texts:
        ids = np.array([words.look_up(w)[0] for w in TOKEN.findall(text)], np.int64)
        around = np.zeros((len(ids), s.size), np.float32)
        for step in range(1, s.window + 1):
            if len(ids) > step:
                around[:-step] += index[ids[step:]]
                around[step:] += index[ids[:-step]]
        np.add.at(out[:, :-1], ids, around)
        np.add.at(out[:, -1], ids, 1)
    return out


def word_vectors(summed: np.ndarray, s: Settings) -> np.ndarray:
    context, times = summed[:, :-1], summed[:, -1:]
    # The mean vector of all contexts says nothing about a word.
    context = context / np.maximum(times, 1) - context.sum(axis=0) / max(1.0, float(times.sum())) * (times > 0)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return (index_vectors(s) + s.context * context / np.maximum(length, 1e-6)).astype(np.float32)


def fit_network(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, s: Settings) -> Network:
    """Fits the layers on the rows outside `calibrate` and the temperature on those inside."""
    train = ~calibrate
    if len(set(y[train])) < 2:
        train = np.ones(len(y), bool)
    mean, spread = x[train, :-1].mean(axis=0), x[train, :-1].std(axis=0) + 1e-3
    net = Network(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, 1.0, mean, spread)
    a, t = net.inputs(x[train]), y[train].astype(np.float64)
    dice = np.random.default_rng(s.seed)
    values = [
        dice.normal(0, 1 / np.sqrt(s.size), (s.size, s.hidden)),
        np.zeros(s.hidden),
        dice.normal(0, 1 / np.sqrt(s.hidden), s.hidden),
        np.zeros(1),
    ]
    slow, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, s.rounds + 1):
        hidden = np.tanh(a @ values[0] + values[1])
        off = (_sigmoid(hidden @ values[2] + values[3][0]) - t) / len(t)
        back = np.outer(off, values[2]) * (1 - hidden**2)
        slopes = [a.T @ back + s.decay * values[0], back.sum(axis=0), hidden.T @ off + s.decay * values[2], np.array([off.sum()])]
        for i, g in enumerate(slopes):
            slow[i] = 0.9 * slow[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            values[i] -= s.rate * (slow[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(values[0], values[1], values[2], float(values[3][0]), 1.0, mean, spread)
    kept = calibrate if calibrate.any() else train
    return net._replace(temperature=_temperature(net.logits(x[kept]), y[kept]))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss among a range of them."""
    tried = np.geomspace(0.5, 8, 49)
    sign = np.where(y == 1, 1.0, -1.0)
    loss = [np.logaddexp(0, -sign * logits / t).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def fit(
    texts: DataFrame,
    labels: DataFrame,
    allowed: Column | None = None,
    settings: Settings = Settings(),
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> Model:
    """Learns from texts whose id has a label, at most `settings.rows` of them and only `allowed` ids.

    The picked ids are at most that many and are broadcast; the picked texts are written once, as three passes read
    them. `allowed` is a condition on the column `id`.
    """
    s = settings
    spark = texts.sparkSession
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1)
    )
    if allowed is not None:
        known = known.where(allowed)
    order = F.xxhash64(F.col("id").cast("string"), F.lit(s.seed))
    # Of contradicting labels of one id the higher counts.
    picked = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(order, "id").limit(s.rows)
    read = texts.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    folder = new_folder(spark, "quality-sample")
    # One text of an id that several rows have, so that the bound holds for rows too.
    one = read.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t"), "t")).alias("one"))
    one.select("one.t", "y", (F.pmod(order, F.lit(5)) == 0).alias("c")).write.parquet(folder)
    sample = spark.read.parquet(folder).coalesce(8)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = contexts((t for b in few_rows(batches) for t in b.column(0).to_pylist()), s)
        yield pa.RecordBatch.from_arrays([pa.array([summed.tobytes()], pa.binary())], ["sums"])

    summed = np.zeros((s.buckets, s.size + 1), np.float32)
    for row in sample.select("t").mapInArrow(sum_up, "sums BINARY").toLocalIterator():
        summed += np.frombuffer(row["sums"], np.float32).reshape(summed.shape)
    vectors = word_vectors(summed, s)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(s)
        for b in few_rows(batches):
            x = [v.tobytes() for v in pool(b.column(0).to_pylist(), vectors, words)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1), b.column(2)], ["x", "y", "c"])

    rows = sample.mapInArrow(pooled, "x BINARY, y INT, c BOOLEAN").collect()
    # The same rows in the same order, however the tasks were cut.
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))
    y = np.array([r["y"] for r in rows], np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Model(vectors, None, share, s)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64)
    return Model(vectors, fit_network(x, y, np.array([r["c"] for r in rows]), s), share, s)


def score(texts: DataFrame, model: Model, *keep: str, text: str = "text", into: str = "score") -> DataFrame:
    """(kept columns, probability of label 1) of every row, one pass without a shuffle."""
    spark = texts.sparkSession
    n = len(keep)
    given = text in keep
    read = texts.select(*keep, *([] if given else [F.col(text).cast("string").alias("_t")]))
    at = keep.index(text) if given else n
    # Vectors of fixed size: buckets x size.
    # Arrays and numbers only: unlike a function a broadcast names its classes, and executors may not have them.
    shared = spark.sparkContext.broadcast((model.vectors, None if model.network is None else tuple(model.network)))
    share, settings = model.share, model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, layers = shared.value
        network = None if layers is None else Network(*layers)
        words = _Words(settings)
        for b in few_rows(batches):
            given = b.column(at).to_pylist()
            if network is None:
                scores = np.full(b.num_rows, share)
            else:
                scores = network.scores(pool(given, vectors, words).astype(np.float64))
                # No letter, no words to judge by: that is no text of quality.
                scores[[not any(map(str.isalpha, t or "")) for t in given]] = 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(scores, pa.float64())], [*keep, into])

    return read.mapInArrow(run, T.StructType([*read.schema[:n], T.StructField(into, T.DoubleType())]))


def held_out(id: Column) -> Column:
    """Rows from whose labels nothing is learned."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))
