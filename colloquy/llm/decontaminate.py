"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

Texts are compared in lower case with runs of white space as one space. A benchmark item is cut into segments of
`segment` characters that overlap by half; one shorter than that is a segment by itself. A segment of m characters
occurs with at most e = rate * m edits only where it shares m + 1 - q * (e + 1) of its q-grams within e diagonals.
So the q-grams of a document that a segment has are counted in diagonal bands of width 2e that overlap by half, and
bands that reach the bound are aligned exactly. As many of a segment's commonest q-grams as the bound allows are left
out of the count, and the bound is lowered by as many, which loses nothing.

Items are read in blocks of bounded size, each compared with all documents in one pass without a shuffle.

Defined results: null and empty texts and items have no matches; items shorter than q characters, which would be found
everywhere, are not looked for; rows with equal ids give one finding per item together; equal items are found each;
an empty table on either side gives no findings, and then `drop_leaks` keeps every row; columns that are not named
are ignored by `find_leaks` and left alone by `drop_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from colloquy.llm.batches import few_rows


class Settings(NamedTuple):
    q: int = 8
    segment: int = 96
    rate: float = 0.08
    # Characters of items compared in one pass.
    block: int = 2_000_000
    # Characters of documents looked at together in a task.
    chunk: int = 1 << 19


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with single spaces, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes <= 32) | (codes == 0xA0) | (codes == 0x85) | ((codes >= 0x2000) & (codes <= 0x200A)) | (codes == 0x3000)
    again = np.zeros(len(codes), bool)
    again[1:] = space[1:] & space[:-1]
    at = np.flatnonzero(~again)
    return np.where(space, np.uint32(32), codes)[at], at


def trimmed(codes: np.ndarray) -> np.ndarray:
    text = np.flatnonzero(codes != 32)
    return codes[text[0] : text[-1] + 1] if len(text) else codes[:0]


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Hashes of 1, 2, 4, ... characters; those that add up to q are joined.
    power, size, made, done = 0x9E3779B97F4A7C15, 1, None, 0
    run = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    left = q
    while True:
        if left & size:
            part = run[done : done + n]
            made = part.copy() if made is None else made * np.uint64(power) + part
            done += size
            left ^= size
            if not left:
                break
        run = run[: len(run) - size] * np.uint64(power) + run[size:]
        power = power * power % 2**64
        size *= 2
    made ^= made >> np.uint64(29)
    return made * np.uint64(0xBF58476D1CE4E5B9)


class Index(NamedTuple):
    """Segments of a block of items and where their counted q-grams are."""

    item: np.ndarray
    codes: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    maybe: np.ndarray


MAYBE_BITS = 22


def segments(codes: np.ndarray, s: Settings) -> list[np.ndarray]:
    if len(codes) <= s.segment:
        return [codes] if len(codes) >= s.q else []
    starts = [*range(0, len(codes) - s.segment, s.segment // 2), len(codes) - s.segment]
    return [codes[i : i + s.segment] for i in starts]


def build(items: list[tuple[object, str]], s: Settings) -> Index | None:
    """The index of (id, text) items; None if there is nothing to look for."""
    ids, codes = [], []
    for k, (_, text) in enumerate(items):
        for part in segments(trimmed(normal(text)[0]), s):
            ids.append(k)
            codes.append(part)
    if not codes:
        return None
    hashed = [grams(c, s.q) for c in codes]
    every, times = np.unique(np.concatenate(hashed), return_counts=True)
    edits = np.array([int(s.rate * len(c)) for c in codes])
    # Too few characters for the bound to hold with so many edits: fewer are allowed.
    for i, c in enumerate(codes):
        edits[i] = min(edits[i], (len(c) - s.q) // s.q)
    full = np.array([len(c) + 1 - s.q * (e + 1) for c, e in zip(codes, edits)])
    bound, kept_hash, kept_segment, kept_place = [], [], [], []
    for i, h in enumerate(hashed):
        spare = max(0, (3 * int(full[i])) // 4 - 1)
        rare = np.sort(np.argsort(times[np.searchsorted(every, h)], kind="stable")[: len(h) - spare])
        bound.append(max(1, int(full[i]) - spare))
        kept_hash.append(h[rare])
        kept_segment.append(np.full(len(rare), i))
        kept_place.append(rare)
    flat = np.concatenate(kept_hash)
    order = np.argsort(flat, kind="stable")
    hashes, first = np.unique(flat[order], return_index=True)
    maybe = np.zeros(1 << MAYBE_BITS, bool)
    maybe[hashes >> np.uint64(64 - MAYBE_BITS)] = True
    return Index(
        np.array(ids), codes, edits, np.array(bound), hashes, np.append(first, len(flat)),
        np.concatenate(kept_segment)[order], np.concatenate(kept_place)[order], maybe,
    )


def align(patterns: np.ndarray, texts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits that turn each pattern into a part of its text within a band of diagonals, and where that ends.

    Row k of `texts` begins at the band's lowest diagonal; the band has `width` diagonals. Both are matrices of code
    points; a text is padded with zeros, which equal nothing.
    """
    k, m = patterns.shape
    steps = np.arange(width)
    cost = np.zeros((k, width), np.int32)
    for i in range(m):
        wrong = texts[:, i : i + width] != patterns[:, i : i + 1]
        best = cost + wrong
        best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(best - steps, axis=1) + steps
    end = cost.argmin(axis=1)
    return cost[np.arange(k), end], end + m


def search(codes: np.ndarray, index: Index, s: Settings) -> list[tuple[int, int, int, int]]:
    """(segment, edits, start, end) of every verified occurrence in a run of code points."""
    hashed = grams(codes, s.q)
    at = np.flatnonzero(index.maybe[hashed >> np.uint64(64 - MAYBE_BITS)])
    if not len(at):
        return []
    slot = np.searchsorted(index.hashes, hashed[at])
    slot[slot == len(index.hashes)] = 0
    same = index.hashes[slot] == hashed[at]
    at, slot = at[same], slot[same]
    # Every place of a q-gram in a segment is a diagonal.
    times = index.first[slot + 1] - index.first[slot]
    which = np.repeat(index.first[slot] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
    segment = index.segment[which]
    diagonal = np.repeat(at, times) - index.place[which]
    width = np.maximum(1, 2 * index.edits[segment])
    shift = len(codes) + 4 * s.segment
    found = []
    for half in (0, 1):
        band = (diagonal + s.segment + half * (width // 2)) // width
        key, many = np.unique(segment * shift + band, return_counts=True)
        own, band = key // shift, key % shift
        full = many >= index.bound[own]
        own, band = own[full], band[full]
        wide = np.maximum(1, 2 * index.edits[own])
        found.append(np.stack([own, band * wide - s.segment - half * (wide // 2)], axis=1))
    return _verify(np.unique(np.concatenate(found), axis=0), codes, index)


def _verify(found: np.ndarray, codes: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    out = []
    sizes = np.array([len(index.codes[i]) for i in found[:, 0]], np.int64)
    for m in np.unique(sizes):
        of_size = found[sizes == m]
        for begin in range(0, len(of_size), 2048):
            part = of_size[begin : begin + 2048]
            e = int(index.edits[part[0, 0]])
            # A path that starts in the band leaves it by e at most on either side.
            low, width = part[:, 1] - e, 4 * e + 1
            places = low[:, None] + np.arange(m + width)
            inside = (places >= 0) & (places < len(codes))
            texts = np.where(inside, codes[np.clip(places, 0, len(codes) - 1)], 0)
            patterns = np.stack([index.codes[i] for i in part[:, 0]])
            cost, end = align(patterns, texts, width)
            hit = np.flatnonzero(cost <= e)
            if not len(hit):
                continue
            # Backwards from the end the same tells where it starts.
            ends = low[hit] + end[hit]
            back = ends[:, None] - 1 + 2 * e - np.arange(m + width)
            inside = (back >= 0) & (back < ends[:, None])
            texts = np.where(inside, codes[np.clip(back, 0, len(codes) - 1)], 0)
            _, size = align(patterns[hit, ::-1], texts, width)
            starts = np.maximum(0, ends - (size - 2 * e))
            out += list(zip(part[hit, 0].tolist(), cost[hit].tolist(), starts.tolist(), ends.tolist()))
    return out


class Leak(NamedTuple):
    item: int
    start: int
    end: int
    segments: int
    edits: int


def leaks_of(texts: list[str | None], index: Index, s: Settings) -> list[list[Leak]]:
    """Per text its findings, one per item, in places of the text."""
    out: list[list[Leak]] = [[] for _ in texts]
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0
    # Texts are put one behind the other with a gap that no segment crosses.
    gap = np.zeros(2 * s.segment, np.uint32)

    def flush() -> None:
        nonlocal size
        if held:
            starts = np.cumsum([0, *[len(c) + len(gap) for _, c, _ in held[:-1]]])
            codes = np.concatenate([x for _, c, _ in held for x in (c, gap)])
            by: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
            for segment, edits, start, end in search(codes, index, s):
                k = int(np.searchsorted(starts, end - 1, "right")) - 1
                hit = segment, edits, max(0, start - starts[k]), end - starts[k]
                by.setdefault((k, int(index.item[segment])), []).append(hit)
            for (k, item), hits in sorted(by.items()):
                row, codes_of, at = held[k]
                last = len(codes_of)
                best = {}
                for segment, edits, *_ in hits:
                    best[segment] = min(best.get(segment, edits), edits)
                first, end = int(at[min(h[2] for h in hits)]), int(at[min(last, max(h[3] for h in hits)) - 1]) + 1
                out[row].append(Leak(item, first, end, len(best), sum(best.values())))
            held.clear()
            size = 0

    for row, text in enumerate(texts):
        if text:
            codes, at = normal(text)
            held.append((row, codes, at))
            size += len(codes)
            if size >= s.chunk:
                flush()
    flush()
    return out


def blocks(items: DataFrame, id: str, text: str, s: Settings) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of bounded size; the driver holds one partition of items and one block at a time."""
    held, size = [], 0
    for row in items.select(id, F.col(text).cast("string")).toLocalIterator():
        if row[1]:
            held.append((row[0], row[1]))
            size += len(row[1])
            if size >= s.block:
                yield held
                held, size = [], 0
    if held:
        yield held


def find_leaks(
    texts: DataFrame,
    items: DataFrame,
    settings: Settings = Settings(),
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, item, start, end, n_segments, n_edits): one row per document and item found in it.

    Reads the items while the plan is made.
    """
    s = settings
    read = texts.select(F.col(id), F.col(text).cast("string").alias("_t"))
    kind = items.schema[item].dataType
    schema = T.StructType(
        [
            read.schema[0],
            T.StructField(item, kind),
            *[T.StructField(c, T.LongType()) for c in ("start", "end", "n_segments", "n_edits")],
        ]
    )
    result = None
    for block in blocks(items, item, item_text, s):
        part = read.mapInArrow(_finder(block, s, schema.names), schema)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return texts.sparkSession.createDataFrame([], schema)
    return result.groupBy(id, item).agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max("n_segments").alias("n_segments"),
        F.min("n_edits").alias("n_edits"),
    )


def _finder(block: list[tuple[object, str]], s: Settings, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build(block, s)
        for batch in few_rows(batches):
            if index is None:
                continue
            found = [(i, x) for i, own in enumerate(leaks_of(batch.column(1).to_pylist(), index, s)) for x in own]
            if found:
                numbers = zip(*[(x.start, x.end, x.segments, x.edits) for _, x in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([i for i, _ in found])),
                        pa.array([block[x.item][0] for _, x in found]),
                        *[pa.array(c, pa.int64()) for c in numbers],
                    ],
                    names,
                )

    return run


def drop_leaks(
    texts: DataFrame,
    items: DataFrame,
    settings: Settings = Settings(),
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """All rows and columns of texts in which no item is found."""
    s = settings

    def keep(block: list[tuple[object, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = build(block, s)
            for batch in few_rows(batches):
                if index is not None:
                    at = batch.schema.get_field_index(text)
                    found = leaks_of(batch.column(at).to_pylist(), index, s)
                    batch = batch.filter(pa.array([not x for x in found], pa.bool_()))
                yield batch

        return run

    for block in blocks(items, item, item_text, s):
        texts = texts.mapInArrow(keep(block), texts.schema)
    return texts
