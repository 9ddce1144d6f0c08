"""Repeated strings across documents, by suffix arrays over what may repeat.

A byte of a document is removed if it lies in a string of `length` bytes that also starts in a document of a smaller
id. Strings are judged on the input.

1.  Each string of that length has an anchor: of the grams in it, the one of the smallest hash. Equal strings have
    equal anchors, so it is enough to compare the surroundings of anchors with equal grams. Tasks find anchors with
    one pass of numpy over many documents and send on, per anchor, hashes of the gram and of the surroundings in
    which every string with this anchor lies. Equal surroundings within a batch are put together first.
2.  Where whole surroundings are equal, all documents but the one of the smallest id lose them. What is left are grams
    whose surroundings differ from document to document: the edges of what is repeated.
3.  For those, and only for those, the surroundings themselves are cut out of the texts, brought together by gram,
    and put one behind the other in shards. A suffix array of each shard, by induced sorting, and the common prefixes
    of neighbours in it tell which strings of the full length occur more than once, and in which document first.
4.  A gram with more different surroundings, or more places left, than a shard should hold is compared by all its
    strings instead, as hashes grouped by the engine, so that no group is gathered in one task.

Equal surroundings are recognised by 96 bits of hash and the strings of step 4 by 128; the rest is compared by bytes.

Defined results: a null text is empty; a text shorter than `length` loses nothing; a row without an id has no place in
the order, so it loses nothing and takes nothing away; rows of equal ids are one document to each other and
take nothing from one another; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from colloquy.llm.batches import few_rows
from colloquy.llm.suffix_array import permuted_common_prefixes, suffix_array
from colloquy.sources.shared import new_folder

# What an anchor's fate is: undecided, a gram that is common everywhere, all of its surroundings go, to be compared by
# strings; and what comes of that, (start, end) pairs to go and starts of strings to go.
OPEN, COMMON, WHOLE, STRINGS, PAIRS, STARTS = range(6)


class Settings(NamedTuple):
    length: int = 50
    gram: int = 20
    # Documents whose anchors are put together before they are sent on.
    batch: int = 2500
    # Bytes looked at together when anchors are searched, and of a shard.
    chunk: int = 1 << 18
    shard: int = 1 << 19
    # Different surroundings of one gram: more than this in a batch, or in all, and it is compared by strings. In all,
    # equal surroundings within a document count as often as they are there.
    in_batch: int = 256
    in_all: int = 10_000

    @property
    def before(self) -> int:
        """Bytes before an anchor that a string with this anchor may have."""
        return self.length - self.gram


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on."""
    n = len(data) - size + 1
    run = data.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    power, width, done, left, made = 0x9E3779B97F4A7C15, 1, 0, size, None
    while True:
        if left & width:
            part = run[done : done + n]
            made = part.copy() if made is None else made * np.uint64(power) + part
            done, left = done + width, left ^ width
            if not left:
                return _mix(made)
        run = run[:-width] * np.uint64(power) + run[width:]
        power, width = power * power % 2**64, 2 * width


POSITION = np.uint64((1 << 28) - 1)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, s: Settings):
    """(place, gram hash, hash of the surroundings) of all anchors in texts that lie one behind the other in
    `data`, each at least `length` long; in order of place."""
    hashes = gram_hashes(data, s.gram)
    # The smallest hash of each window, and of equal ones the first: the place is in the low bits.
    low = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
    wide, size = s.before + 1, 1
    while 2 * size <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    # Windows that stay inside their text.
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends - s.length + 1] -= 1
    valid = np.cumsum(inside[:-1])[: len(low)] > 0
    place = (low & POSITION).astype(np.int64)[valid]
    place = place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place
    text = np.searchsorted(starts, place, "right") - 1
    first = np.maximum(starts[text], place - s.before)
    last = np.minimum(ends[text], place + s.length) - s.gram
    around = _mix(hashes[first] + (place - first).astype(np.uint64))
    for step in range(s.gram, s.length + s.before - s.gram, s.gram):
        around = _mix(around * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(first + step, last)])
    around = _mix(around * np.uint64(0x9E3779B97F4A7C15) + hashes[last] + (last - first).astype(np.uint64))
    return place, text, hashes[place], around


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte: all their lowest bytes, then the next ones; what is nearly all zeros packs well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _low(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _widened(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel()


CELL = "bucket INT, kind INT, ids BINARY, marks BINARY, counts BINARY, places BINARY, grams BINARY, arounds BINARY"
CELL_NAMES = [c.split()[0] for c in CELL.split(", ")]
CELL_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 6]


def _cells(bucket: int, kind: int, ids, marks, places, grams=None, arounds=None) -> tuple:
    """A row of anchors in order of (document, place); documents are written once per run."""
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    counts = np.diff(np.r_[new, len(ids)]).astype(np.uint32)
    steps = np.r_[places[:1], np.diff(places)].astype(np.int32)
    return (
        bucket, kind, _planes(ids[new]), _planes(marks[new]), _planes(counts), _planes(steps),
        None if grams is None else _low(grams), None if arounds is None else _low(arounds),
    )


def _opened(row: dict):
    counts = _unplaned(row["counts"], np.uint32)
    ids = np.repeat(_unplaned(row["ids"], np.int64), counts)
    marks = np.repeat(_unplaned(row["marks"], np.int32), counts)
    return ids, marks, np.cumsum(_unplaned(row["places"], np.int32).astype(np.int64))


def _find(s: Settings, buckets: int):
    """Anchors of a batch of documents, dealt out by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, s.batch):
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = _bytes_of(batch.column(2))
            long = np.flatnonzero(np.diff(offsets) >= s.length)
            found, at = [], 0
            while at < len(long):
                # As many texts as a chunk holds, one at least.
                end = int(np.searchsorted(offsets[long + 1], offsets[long[at]] + s.chunk, "right"))
                own = long[at : max(end, at + 1)]
                found.append(_of_texts(data, offsets[own], offsets[own + 1], own, s))
                at += len(own)
            if not found:
                continue
            row, place, gram, around = (np.concatenate(c) for c in zip(*found))
            rows: list[tuple] = []
            for cell in _dealt(ids[row], marks[row], place, gram, around, buckets, s):
                rows.append(cell)
                if len(rows) == 64:
                    yield _batch_of(rows)
                    rows = []
            if rows:
                yield _batch_of(rows)

    return run


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), CELL_KINDS)], CELL_NAMES)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts where they lie, and where each begins and ends; no text may be null."""
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), bounds


def _of_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, s: Settings):
    """(row, place in its text, gram, surroundings) of the anchors of texts in order within `data`."""
    low, high = int(starts[0]), int(ends[-1])
    if len(rows) == 1 and high - low > 1 << 27:
        # A text that the place bits cannot number, in pieces with enough on either side for whole surroundings.
        step, parts = 1 << 26, []
        for begin in range(low, high - s.length + 1, step):
            first, last = max(low, begin - 2 * s.length), min(high, begin + step + 3 * s.length)
            _, place, gram, around = _of_texts(data, np.array([first]), np.array([last]), rows, s)
            own = (place + first >= begin) & (place + first < begin + step)
            parts.append((place[own] + first - low, gram[own], around[own]))
        place, gram, around = (np.concatenate(c) for c in zip(*parts))
        return np.full(len(place), rows[0]), place, gram, around
    place, text, gram, around = anchors(data[low:high], starts - low, ends - low, s)
    return rows[text], place - (starts - low)[text], gram, around


def _dealt(ids, marks, place, gram, around, buckets: int, s: Settings) -> Iterator[tuple]:
    """Cells of a batch: of equal surroundings only those of the smallest document are left open."""
    both = gram ^ _mix(around)
    order = np.argsort(both, kind="stable")
    both = both[order]
    new = np.r_[True, both[1:] != both[:-1]]
    first = np.empty(len(order), ids.dtype)
    first[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    kind = np.where(ids == first, OPEN, WHOLE)
    del both, first
    grams, which, times = np.unique(gram, return_inverse=True, return_counts=True)
    if (times > s.in_batch).any():
        lead = np.zeros(len(order), bool)
        lead[order[new]] = True
        different = np.bincount(which[lead], minlength=len(grams))
        common = different > s.in_batch
        kind[common[which] & (kind == OPEN)] = STRINGS
        for g in grams[common]:
            yield (_bucket(np.array([g]), buckets)[0], COMMON, None, None, None, None, _low(np.array([g])), None)
    bucket = _bucket(gram, buckets)
    order = np.argsort(bucket * 4 + kind, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order] * 4 + kind[order])) + 1
    for own in np.split(order, cuts):
        k = int(kind[own[0]])
        more = (gram[own], around[own]) if k == OPEN else ()
        yield _cells(int(bucket[own[0]]), k, ids[own], marks[own], place[own], *more)


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    # Anchors have small hashes, so they are mixed once more to be dealt out evenly.
    return ((_mix(gram) >> np.uint64(48)).astype(np.int64) * buckets) >> 16


FATES = "id BIGINT, mark INT, kind INT, data BINARY"


def _resolve(s: Settings):
    """What becomes of the anchors of each bucket; rows of a bucket stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield from _fates(held, s)
                    held = []
                held.append(row)
        if held:
            yield from _fates(held, s)

    return run


def _fates(rows: list[dict], s: Settings) -> Iterator[pa.RecordBatch]:
    parts: dict[int, list[tuple]] = {WHOLE: [], STRINGS: [], OPEN: []}
    opened, grams, arounds = [], [], []
    common = [_widened(r["grams"]) for r in rows if r["kind"] == COMMON]
    for r in rows:
        if r["kind"] in (WHOLE, STRINGS):
            parts[r["kind"]].append(_opened(r))
        elif r["kind"] == OPEN:
            opened.append(_opened(r))
            grams.append(_widened(r["grams"]))
            arounds.append(_widened(r["arounds"]))
    if opened:
        ids, marks, places = (np.concatenate(c) for c in zip(*opened))
        gram, around = np.concatenate(grams), np.concatenate(arounds)
        order = np.lexsort((ids, around, gram))
        ids, marks, places, gram, around = (c[order] for c in (ids, marks, places, gram, around))
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = new_gram | np.r_[True, around[1:] != around[:-1]]
        whole = ids != ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        starts, of = np.flatnonzero(new_gram), np.cumsum(new_gram) - 1
        different = np.add.reduceat(new.astype(np.int64), starts)
        several = np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts)
        everywhere = np.isin(gram[starts], np.concatenate(common)) if common else np.zeros(len(starts), bool)
        # What is cut out is every open place of a gram, also those of equal surroundings in one document.
        places_of = np.add.reduceat((~whole).astype(np.int64), starts)
        by_strings = everywhere | ((np.maximum(different, places_of) > s.in_all) & (different > 1) & several)
        by_bytes = (different > 1) & several & ~by_strings
        for kind, mine in ((WHOLE, whole), (STRINGS, by_strings[of] & ~whole), (OPEN, by_bytes[of] & ~whole)):
            parts[kind].append((ids[mine], marks[mine], places[mine]))
    for kind, found in parts.items():
        if not found:
            continue
        ids, marks, places = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((places, marks, ids))
        ids, marks, places = ids[order], marks[order], places[order].astype(np.uint32)
        new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])]) if len(ids) else []
        data = [x.tobytes() for x in np.split(places, new[1:])] if len(ids) else []
        for at in range(0, len(data), 20_000):
            own = new[at : at + 20_000]
            columns = [pa.array(ids[own]), pa.array(marks[own]), pa.array(np.full(len(own), kind, np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data[at : at + 20_000], pa.binary())], ["id", "mark", "kind", "data"])


PIECES = "kind INT, g BIGINT, g2 BIGINT, id BIGINT, mark INT, start INT, bytes BINARY"


def _cut(s: Settings):
    """Surroundings of open anchors, and hashes of all strings of those to be compared by strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out: list[list] = [[] for _ in range(7)]
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, fates in enumerate(batch.column(3)):
                open_at = _places(fates, OPEN)
                string_at = _places(fates, STRINGS)
                if not len(open_at) and not len(string_at):
                    continue
                text = batch.column(2)[i].as_py().encode()
                data = np.frombuffer(text, np.uint8)
                if len(open_at):
                    # The gram eight bytes at a time, the last eight perhaps in part for the second time.
                    steps = [*range(0, s.gram - 8, 8), s.gram - 8]
                    eights = data[open_at[:, None] + np.concatenate([np.arange(8) + x for x in steps])].view(np.uint64)
                    keys = np.zeros(len(open_at), np.uint64)
                    for c in range(len(steps)):
                        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + eights[:, c])
                    first = np.maximum(0, open_at - s.before)
                    last = np.minimum(len(data), open_at + s.length)
                    n = len(open_at)
                    out[0] += [OPEN] * n
                    out[1] += keys.view(np.int64).tolist()
                    out[2] += [None] * n
                    out[5] += first.tolist()
                    out[6] += [text[a:b] for a, b in zip(first.tolist(), last.tolist())]
                    out[3] += [ids[i]] * n
                    out[4] += [marks[i]] * n
                if len(string_at):
                    steps = np.zeros(len(data) + 1, np.int64)
                    np.add.at(steps, np.maximum(0, string_at - s.before), 1)
                    np.add.at(steps, string_at + 1, -1)
                    at = np.flatnonzero(np.cumsum(steps)[: len(data) - s.length + 1] > 0)
                    hashes = gram_hashes(data, s.gram)
                    one = _mix(hashes[at])
                    for step in (*range(s.gram, s.before, s.gram), s.before):
                        one = _mix(one * np.uint64(0x9E3779B97F4A7C15) + hashes[at + step])
                    two = _mix(hashes[at] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1))
                    for step in (*range(s.gram, s.before, s.gram), s.before):
                        two = _mix((two ^ hashes[at + step]) * np.uint64(0x94D049BB133111EB))
                    for low in range(0, len(at), 20_000):
                        own = slice(low, low + 20_000)
                        n = len(at[own])
                        out[0] += [STRINGS] * n
                        out[1] += one[own].view(np.int64).tolist()
                        out[2] += two[own].view(np.int64).tolist()
                        out[3] += [ids[i]] * n
                        out[4] += [marks[i]] * n
                        out[5] += at[own].tolist()
                        out[6] += [None] * n
                        if len(out[0]) >= 20_000:
                            yield _pieces(out)
                            out = [[] for _ in range(7)]
                if len(out[0]) >= 20_000:
                    yield _pieces(out)
                    out = [[] for _ in range(7)]
            if out[0]:
                yield _pieces(out)

    return run


def _pieces(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(out, kinds)], [c.split()[0] for c in PIECES.split(", ")]
    )


def _places(fates, kind: int, form: str = "<u4") -> np.ndarray:
    """Places of one kind out of a row's list of (kind, data)."""
    listed = fates.values
    if listed is None:
        return np.empty(0, np.int64)
    own = listed.field("data").filter(pc.equal(listed.field("kind"), kind)).to_pylist()
    return np.frombuffer(b"".join(own), form).astype(np.int64) if own else np.empty(0, np.int64)


def first_documents(pieces: list[bytes], ids: np.ndarray, s: Settings) -> list[tuple[int, int, int]]:
    """(piece, start, end) of the stretches of pieces that strings of full length cover of which another piece, of
    a smaller document, has one too."""
    joined = b"\0".join(pieces) + b"\0"
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(p) for p in pieces])
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    # Bytes from 2 on, 1 between pieces, 0 at the end.
    text = data.astype(np.uint16) + np.uint16(2)
    text[starts + sizes] = 1
    order = suffix_array(np.append(text, np.uint16(0)), s.length)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(data))
    order = order[order < len(data)]
    # Only what has the full length left can be such a string; nothing else stands between two equal ones.
    order = order[left[order] >= s.length]
    if len(order) < 2:
        return []
    common = permuted_common_prefixes(data, order[:-1], order[1:], s.length)
    run = np.cumsum(np.r_[True, common < s.length]) - 1
    owner = ids[piece[order]]
    first = np.minimum.reduceat(owner, np.flatnonzero(np.r_[True, common < s.length]))[run]
    hit = np.sort(order[first < owner])
    if not len(hit):
        return []
    # Strings of a piece that overlap or touch make one stretch.
    new = np.r_[True, (np.diff(hit) > s.length) | (piece[hit][1:] != piece[hit][:-1])]
    begin = hit[new]
    end = hit[np.r_[np.flatnonzero(new)[1:] - 1, len(hit) - 1]] + s.length
    own = piece[begin]
    return list(zip(own.tolist(), (begin - starts[own]).tolist(), (end - starts[own]).tolist()))


PAIR_NAMES = ["id", "mark", "kind", "data"]


def _shards(s: Settings):
    """Stretches to go, from surroundings that stand together by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = table.column("id").to_numpy()
            start = table.column("start").to_numpy()
            found = first_documents(table.column("bytes").to_pylist(), ids, s)
            if found:
                own, begin, end = (np.array(c) for c in zip(*found))
                pairs = np.stack([start[own] + begin, start[own] + end], axis=1).astype(np.uint32)
                marks = table.column("mark").to_numpy()[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[own], pa.int64()),
                        pa.array(marks, pa.int32()),
                        pa.array(np.full(len(own), PAIRS, np.int32)),
                        pa.array([p.tobytes() for p in pairs], pa.binary()),
                    ],
                    PAIR_NAMES,
                )

        wide = s.length + s.before + 1
        for batch in batches:
            at, grams = 0, batch.column(0).to_numpy()
            if not len(grams):
                continue
            # Where a shard may end: before the first row of another gram.
            cuts = np.flatnonzero(np.diff(grams)) + 1
            if held and held[-1].column(0)[-1].as_py() != grams[0]:
                cuts = np.r_[0, cuts]
            while True:
                k = np.searchsorted(cuts, at + max(0, -(-(s.shard - size) // wide)))
                if k == len(cuts):
                    break
                if cuts[k] > at:
                    held.append(batch.slice(at, cuts[k] - at))
                yield from close(pa.Table.from_batches(held))
                held, size, at = [], 0, int(cuts[k])
            held.append(batch.slice(at))
            size += (len(grams) - at) * wide
        if held:
            yield from close(pa.Table.from_batches(held))

    return run


def _remove(s: Settings, id: str):
    """Spans to go, and what is left, from a row's list of fates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in few_rows(batches, 500):
            sizes, spans, kept = [], [], []
            for text, fates in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                n = len(data)
                whole = _places(fates, WHOLE)
                pairs = _places(fates, PAIRS).reshape(-1, 2)
                single = _places(fates, STARTS, ">u4")
                starts = np.r_[np.maximum(0, whole - s.before), pairs[:, 0], single]
                ends = np.r_[np.minimum(n, whole + s.length), pairs[:, 1], single + s.length]
                mine = []
                if len(starts):
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, starts, 1)
                    np.add.at(steps, ends, -1)
                    gone = np.r_[0, (np.cumsum(steps)[:n] > 0).astype(np.int8), 0]
                    edges = np.diff(gone)
                    mine = [
                        {"start": a, "end": b}
                        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())
                    ]
                    data = np.frombuffer(data, np.uint8)[gone[1:-1] == 0].tobytes()
                sizes.append(n)
                spans.append(mine)
                kept.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                [id, "n_bytes", "spans", "kept"],
            )

    return run


def remove_repeats(
    texts: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_bytes, spans, kept): the maximal runs of removed bytes of every row, and its other bytes joined.

    Runs a job that finds the fate of all anchors and writes those of repeated ones.
    """
    s = settings
    spark = texts.sparkSession
    # Rows of equal ids are told apart by a mark of their text.
    read = texts.select(
        F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")
    ).select("id", F.hash("t").alias("mark"), "t")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * read.rdd.getNumPartitions())
    known = read.where(F.col("id").isNotNull())
    cells = known.mapInArrow(_find(s, buckets), CELL)
    folder = new_folder(spark, "repeats")
    cells.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_resolve(s), FATES).write.option(
        "compression", "zstd"
    ).parquet(folder)
    fates = spark.read.schema(FATES).parquet(folder)

    def with_fates(found: DataFrame, how: str) -> DataFrame:
        listed = found.groupBy(F.col("id").alias("i"), F.col("mark").alias("m")).agg(
            F.collect_list(F.struct("kind", "data")).alias("fates")
        )
        same = (F.col("id") == F.col("i")) & (F.col("mark") == F.col("m"))
        return known.join(listed, same, how).select("id", "mark", "t", "fates")

    def cut(kind: int) -> DataFrame:
        # Only texts with such anchors go to a task; all joins with the texts read one shuffle of them.
        return with_fates(fates.where(F.col("kind") == kind), "inner").mapInArrow(_cut(s), PIECES)

    by_bytes = (
        cut(OPEN)
        .select("g", "id", "mark", "start", "bytes")
        .repartition("g")
        .sortWithinPartitions("g")
        .mapInArrow(_shards(s), FATES)
    )
    strings = cut(STRINGS).select("g", "g2", "id", "mark", "start")
    smallest = strings.groupBy("g", "g2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    start = F.unhex(F.lpad(F.hex("start"), 8, "0"))
    by_strings = (
        strings.join(smallest.drop("last"), ["g", "g2"])
        .where(F.col("id") > F.col("first"))
        .select("id", "mark", F.lit(STARTS).alias("kind"), start.alias("data"))
    )
    gone = fates.where(F.col("kind") == WHOLE).unionByName(by_bytes).unionByName(by_strings)
    final = with_fates(gone, "left").select("id", "t", "fates")
    unknown = read.where(F.col("id").isNull()).select("id", "t", F.lit(None).cast(final.schema["fates"].dataType).alias("fates"))
    final = final.unionByName(unknown)
    schema = T.StructType(
        [
            T.StructField(id, T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    return final.mapInArrow(_remove(s, id), schema)
