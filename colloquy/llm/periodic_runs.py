"""Stretches of text that repeat with a period, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period q, at least 12 words and two periods long, that no
neighbouring word extends. The texts of a pack are compressed together by Re-Pair: a round replaces all pairs that
are more frequent than those they overlap with, until no pair occurs twice. What remains of a text is split in half
again and again. Each rule X -> L R, and each split, is looked at once, for runs across its boundary: one of the
seven windows of six words around the boundary recurs a period away, so recurring windows name the periods, and
longest common extensions the runs. They are translated to all places where the rule was used. A run lies within
the lowest node that holds all of it, so it is found whole; pieces of it that higher or other nodes cut off are inside
it, have the same period, and go when intervals are merged.

Before that, words that cannot be in a run are put aside: a run of 12 words has windows of six words that recur in
it, at most five apart. Extensions compare fingerprints of stretches; each run is then compared word by word, and
should that fail, the pack is done again with other fingerprints.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a null text has none; texts are worked on whole, and a row's result
depends on its text alone, so repeated rows have equal results and ids may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

LEAST = 12
# A window of half the least length: the words of a run that are equal to those a period on are as many in a row.
WINDOW = LEAST // 2
# Bytes of text that are compressed together; a longer text is a pack by itself.
PACK = 4 << 20
# Pairs of windows that are looked at together.
PAIRS = 1 << 21
PRIMES = (2**31 - 1, 2**31 - 19)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Numbers of 64 bits that look random, one for each number."""
    z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that stand for `counts` entries each: the row of every entry, and its number in the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _windows(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, piece and hash of every window inside a piece."""
    piece, nth = _ranges(np.maximum(ends - starts - WINDOW + 1, 0))
    at = starts[piece] + nth
    random = _mixed(words, 1)
    sums = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        sums += random[at + k] * np.uint64(2 * k + 1) ** np.uint64(5)
    return at, piece, sums


def may_repeat(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the texts [start, end) outside which there is no run."""
    while len(starts):
        at, piece, sums = _windows(words, starts, ends)
        # Windows of different pieces do not count as equal; a wrong match only keeps more.
        sums = sums + _mixed(piece, 2)
        order = np.argsort(sums)
        equal = sums[order][1:] == sums[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:]] |= equal
        again[order[:-1]] |= equal
        at, piece = at[again], piece[again]
        if not len(at):
            return at, at
        fresh = np.r_[True, (piece[1:] != piece[:-1]) | (at[1:] - at[:-1] > WINDOW)]
        first, last = at[fresh], at[np.r_[fresh[1:], True]] + WINDOW
        long = last - first >= LEAST
        left = int((last - first)[long].sum())
        much = left > 0.9 * int((ends - starts).sum())
        starts, ends = first[long], last[long]
        if much:
            break
    return starts, ends


class Grammar:
    """Re-Pair over the pieces [start, end) of `words`: rules by their first use, and the places of all uses."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        piece, nth = _ranges(ends - starts)
        at = starts[piece] + nth
        symbol = words[at]
        size = np.ones(len(at), np.int64)
        next_symbol = int(words.max()) + 1 if len(words) else 0
        left, whole, used, places = [], [], [], []
        rules = 0
        while len(symbol) > 1:
            pair = symbol[:-1] * next_symbol + symbol[1:]
            fits = piece[1:] == piece[:-1]
            # In a row of one symbol only every other pair can be replaced.
            same = (symbol[1:] == symbol[:-1]) & fits
            begins = np.flatnonzero(same & ~np.r_[False, same[:-1]])
            into = np.flatnonzero(same)
            odd = (into - begins[np.searchsorted(begins, into, side="right") - 1]) % 2 == 1 if len(into) else into
            fits[into[odd]] = False
            pairs = np.flatnonzero(fits)
            kinds, kind, times = np.unique(pair[pairs], return_inverse=True, return_counts=True)
            if not len(kinds) or times.max() < 2:
                break
            rank = np.empty(len(kinds), np.int64)
            rank[np.lexsort((_mixed(kinds, 3), times))] = np.arange(len(kinds))
            weight = np.full(len(pair) + 2, -1, np.int64)
            weight[pairs + 1] = np.where(times[kind] > 1, rank[kind], -1)
            own = weight[1:-1]
            taken = (own >= 0) & (own > weight[:-2]) & (own > weight[2:])
            of = np.full(len(pair), -1, np.int64)
            of[pairs] = kind
            # A rule is made for what is replaced twice at least, such as the most frequent pair.
            often = np.bincount(of[taken], minlength=len(kinds)) > 1
            taken &= often[of]
            chosen = np.flatnonzero(taken)
            number = np.cumsum(often) - 1
            rule = number[of[chosen]]
            first = np.empty(int(often.sum()), np.int64)
            first[rule[::-1]] = chosen[::-1]
            left.append(size[first])
            whole.append(size[first] + size[first + 1])
            used.append(rule + rules)
            places.append(at[chosen])
            symbol = symbol.copy()
            symbol[chosen] = next_symbol + rule
            size[chosen] += size[chosen + 1]
            kept = np.ones(len(symbol), bool)
            kept[chosen + 1] = False
            symbol, at, size, piece = symbol[kept], at[kept], size[kept], piece[kept]
            next_symbol += len(first)
            rules += len(first)
        none = np.empty(0, np.int64)
        self.left = np.concatenate([none, *left])
        self.size = np.concatenate([none, *whole])
        used, places = np.concatenate([none, *used]), np.concatenate([none, *places])
        order = np.argsort(used, kind="stable")
        # Places of rule r are those from `from_[r]` to `from_[r + 1]`.
        self.places = places[order]
        self.from_ = np.searchsorted(used[order], np.arange(rules + 1))
        self.top = self._splits(at, size, piece)

    @staticmethod
    def _splits(at: np.ndarray, size: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, boundary, end) of the halves of halves of what remains of each piece."""
        none = np.empty(0, np.int64)
        low = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else none
        high = np.r_[low[1:], len(piece)] if len(piece) else none
        out = [(none, none, none)]
        while True:
            two = high - low > 1
            low, high = low[two], high[two]
            if not len(low):
                return tuple(np.concatenate(c) for c in zip(*out))
            middle = (low + high) // 2
            out.append((at[low], at[middle], at[high - 1] + size[high - 1]))
            low, high = np.r_[low, middle], np.r_[middle, high]


class Extensions:
    """How far two places of a text agree, by fingerprints of stretches."""

    def __init__(self, words: np.ndarray, seed: int):
        self.sums, self.powers = [], []
        for i, p in enumerate(PRIMES):
            base = int(_mixed(np.array([seed * 2 + i]), 5)[0]) % (p - 1000) + 500
            powers = np.ones(1, np.int64)
            while len(powers) <= len(words):
                powers = np.r_[powers, powers * pow(base, len(powers), p) % p]
            terms = (_mixed(words, 7 + seed) % np.uint64(p)).astype(np.int64) * powers[: len(words)] % p
            # Terms are below 2**31, so the sum of as many words as fit in memory is exact.
            self.sums.append(np.r_[0, np.cumsum(terms) % p])
            self.powers.append(powers)

    def _equal(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from x on are those from y on; x is before y."""
        same = np.ones(len(x), bool)
        for p, s, w in zip(PRIMES, self.sums, self.powers):
            same &= (s[x + n] - s[x]) % p * w[y - x] % p == (s[y + n] - s[y]) % p
        return same

    def longest(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The most words, up to `most`, that agree from x and y on, or up to them."""
        low, high = np.zeros(len(x), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            n = (low[open_] + high[open_] + 1) // 2
            shift = n if back else 0
            same = self._equal(x[open_] - shift, y[open_] - shift, n)
            low[open_] = np.where(same, n, low[open_])
            high[open_] = np.where(same, high[open_], n - 1)


def _crossing(
    start: np.ndarray, boundary: np.ndarray, end: np.ndarray, windows: tuple[np.ndarray, np.ndarray], agree: Extensions
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period) of the runs within a node [start, end) that its boundary is inside of.

    `windows` are windows by kind and then position, as one number each, and the kind at each position.
    """
    ordered, kind = windows
    n = len(kind)
    low = np.maximum(start, boundary - WINDOW)
    node, nth = _ranges(np.minimum(boundary, end - WINDOW) - low + 1)
    here = low[node] + nth
    known = kind[here] >= 0
    node, here = node[known], here[known]
    half = (end - start)[node] // 2
    base = kind[here] * n
    first = np.searchsorted(ordered, base + np.maximum(start[node], here - half))
    last = np.searchsorted(ordered, base + np.minimum(end[node] - WINDOW, here + half), side="right")
    found = [(np.empty(0, np.int64),) * 4]
    # So many windows together that the pairs fit, one at least.
    total = np.cumsum(last - first)
    at = 0
    while at < len(here):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        own = slice(at, to)
        at = to
        row, nth = _ranges((last - first)[own])
        x, of = here[own][row], node[own][row]
        y = ordered[first[own][row] + nth] - base[own][row]
        other = x != y
        x, y, of = x[other], y[other], of[other]
        # Of windows beside each other that recur equally far away the first one will do.
        order = np.lexsort((x, y - x, of))
        x, y, of = x[order], y[order], of[order]
        fresh = np.r_[True, (of[1:] != of[:-1]) | (np.diff(y - x) != 0) | (np.diff(x) != 1)] if len(x) else other[:0]
        x, y, of = x[fresh], y[fresh], of[fresh]
        x, y = np.minimum(x, y), np.maximum(x, y)
        q = y - x
        begin = x - agree.longest(x, y, x - start[of], back=True)
        stop = y + agree.longest(x, y, end[of] - y, back=False)
        size = stop - begin
        good = (size >= LEAST) & (size >= 2 * q) & (begin < boundary[of]) & (stop > boundary[of])
        found.append((of[good], begin[good], stop[good], q[good]))
    of, begin, stop, q = (np.concatenate(c) for c in zip(*found))
    # Multiples of a period have the same run.
    order = np.lexsort((q, stop, begin, of))
    of, begin, stop, q = of[order], begin[order], stop[order], q[order]
    least = np.r_[True, (np.diff(of) != 0) | (np.diff(begin) != 0) | (np.diff(stop) != 0)] if len(of) else order < 0
    return of[least], begin[least], stop[least], q[least]


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that are inside no other of their period, by start and then period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        group = np.cumsum(np.r_[0, np.diff(period) != 0])
        reach = end + group * (int(end.max()) + 1)
        kept = np.r_[True, reach[1:] > np.maximum.accumulate(reach)[:-1]]
        start, end, period = start[kept], end[kept], period[kept]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts [start, end) of `words`, by start and then period."""
    starts, ends = may_repeat(words, starts, ends)
    none = np.empty(0, np.int64)
    if not len(starts):
        return none, none, none
    # What is left, closed up: pieces lie side by side, and `back` leads to the given places.
    piece, nth = _ranges(ends - starts)
    back = starts[piece] + nth
    _, words = np.unique(words[back], return_inverse=True)
    ends = np.cumsum(ends - starts)
    starts = np.r_[0, ends[:-1]]
    grammar = Grammar(words, starts, ends)
    at, _, sums = _windows(words, starts, ends)
    kind = np.full(len(words), -1, np.int64)
    _, kind[at] = np.unique(sums, return_inverse=True)
    windows = (np.sort(kind[at] * len(words) + at), kind)
    first = grammar.places[grammar.from_[:-1]]
    rules = len(first)
    start = np.r_[first, grammar.top[0]]
    boundary = np.r_[first + grammar.left, grammar.top[1]]
    end = np.r_[first + grammar.size, grammar.top[2]]
    long = np.flatnonzero(end - start >= LEAST)
    for seed in range(100):
        agree = Extensions(words, seed)
        node, begin, stop, q = _crossing(start[long], boundary[long], end[long], windows, agree)
        node = long[node]
        own = node >= rules
        of, offset = node[~own], begin[~own] - start[node[~own]]
        row, nth = _ranges(grammar.from_[of + 1] - grammar.from_[of])
        moved = grammar.places[grammar.from_[of][row] + nth] + offset[row]
        size = (stop - begin)[~own][row]
        begin, stop, q = _merged(np.r_[begin[own], moved], np.r_[stop[own], moved + size], np.r_[q[own], q[~own][row]])
        if _true(words, starts, ends, begin, stop, q):
            return back[begin], back[stop - 1] + 1, q
    raise RuntimeError("fingerprints failed again and again")


def _true(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, stop: np.ndarray, q: np.ndarray) -> bool:
    piece = np.searchsorted(starts, begin, side="right") - 1
    for b, e, p, low, high in zip(*(x.tolist() for x in (begin, stop, q, starts[piece], ends[piece]))):
        if not np.array_equal(words[b : e - p], words[b + p : e]):
            return False
        if b > low and words[b - 1] == words[b - 1 + p] or e < high and words[e] == words[e - p]:
            return False
    return True


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of some rows."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                text = text or b""
                if size + len(text) > PACK and ids:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(id)
                texts.append(text)
                # A row takes room even if it is empty.
                size += len(text) + 100
    if ids:
        yield ids, texts


def find_runs(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): runs as (start, length, period) in words, by start and then period, and the
    words that stay when all periods of a run but its first go, one space between them. No shuffle."""
    kind = texts.schema[id].dataType
    id_type = to_arrow_type(kind)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, given in _packs(batches):
            numbers = _Numbers()
            split = [t.split() for t in given]
            counts = np.array([len(w) for w in split], np.int64)
            words = np.concatenate([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in split])
            ends = np.cumsum(counts)
            starts = ends - counts
            begin, stop, q = runs_of(words, starts, ends)
            of = np.searchsorted(ends, begin, side="right")
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, begin + q, 1)
            np.add.at(change, stop, -1)
            kept = np.cumsum(change)[:-1] == 0
            collapsed = [b" ".join(w) for w in split]
            for i in np.unique(of).tolist():
                collapsed[i] = b" ".join(compress(split[i], kept[starts[i] : ends[i]].tolist()))
            offsets = np.r_[0, np.cumsum(np.bincount(of, minlength=len(ids)))].astype(np.int32)
            fields = [pa.array(c, pa.int64()) for c in (begin - starts[of], stop - begin, q)]
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(run)))
            columns = [pa.array(ids, id_type), pa.array(counts), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    rows = texts.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {kind.simpleString()}, n_words BIGINT, runs ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>, collapsed STRING"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id)
