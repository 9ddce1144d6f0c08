"""Near-duplicates by SimHash fingerprints that differ in few bits.

Fingerprints are made per text in Arrow tasks. Equal ones are put together first. Of fingerprints within the
radius of each other, some blocks of bits are equal, so those that share such blocks meet in a bucket, once for
each choice of blocks. A bucket is compared exactly, tile by tile: rows in order of their population count, tiles
xored against each other, pairs of tiles left out when their counts differ by more than the radius. A large
bucket is dealt out as pairs of tiles, so that no task holds more than two of them. What a task finds linked
it passes on as a spanning tree, never as all pairs; components of the whole follow from those.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like any other; rows
with equal ids are separate rows; a null id is never a component's name, and a component without any id has none;
an empty table gives an empty result; only the id and the text are read, and `keep_one`
leaves all other columns as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from colloquy.llm.batches import few_rows, many_rows
from colloquy.llm.components import components
from colloquy.sources.shared import shared_folder

BITS = 64
SEED = 42
# Fingerprints of one side of a comparison in memory.
TILE = 4096
# Rows of a task's batch of small buckets.
SMALL = 64


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """Bit by bit whether over half the hashes have it; zero of none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(">u8")[0]


def fingerprint_values(texts: list[str | None], words: int = 3) -> np.ndarray:
    """Unsigned fingerprints; a word is what stands between ASCII white space, A to Z are lower-cased."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        # On bytes, lower() and split() know ASCII only.
        found = text.encode().lower().split() if text else []
        if not found:
            continue
        if len(found) <= words:
            shingles: Iterator[bytes] = iter([b" ".join(found)])
        else:
            shingles = map(b" ".join, zip(*[found[k:] for k in range(words)]))
        n = max(1, len(found) - words + 1)
        out[i] = fingerprint(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))
    return out


def fingerprints(texts: DataFrame, *keep: str, text: str = "text", words: int = 3) -> DataFrame:
    """(kept columns, fingerprint) with the fingerprint's bits in a signed number."""
    read = texts.select(*keep, F.col(text).cast("string").alias("_t"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            values = fingerprint_values(batch.column(n).to_pylist(), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(values)], [*keep, "fingerprint"])

    return read.mapInArrow(run, T.StructType([*read.schema[:n], T.StructField("fingerprint", T.LongType())]))


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def masks(radius: int, count: int) -> list[int]:
    """Choices of bits of which two fingerprints within the radius share at least one whole.

    Bits are cut into blocks, `radius` of which may differ; a choice is all other blocks. There are as many blocks as
    it takes for a choice to tell `count` fingerprints well apart.
    """
    for blocks in range(radius + 2, BITS + 1):
        edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
        parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
        chosen = [sum(c) for c in combinations(parts, blocks - radius)]
        if min(m.bit_count() for m in chosen) >= math.log2(max(2, count)) + 4 or len(chosen) > 200:
            break
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def linked(a: np.ndarray, b: np.ndarray, radius: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius; both sides are in order of population count."""
    counts_a, counts_b = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    for i in range(0, len(a), block):
        tile, low, high = a[i : i + block], counts_a[i], counts_a[min(i + block, len(a)) - 1]
        first = np.searchsorted(counts_b, low - radius, "left")
        last = np.searchsorted(counts_b, high + radius, "right")
        for j in range(first, last, block):
            other = b[j : min(j + block, last)]
            x, y = np.nonzero(np.bitwise_count(tile[:, None] ^ other[None, :]) <= radius)
            yield x + i, y + j


def _smallest_linked(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows the first row of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(group: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges of what is linked within each group; rows of a group stand together, by population count."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    xs, ys = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max()))):
        same = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        near = same[np.bitwise_count(values[same] ^ values[same + step]) <= radius]
        xs.append(near)
        ys.append(near + step)
    for at in np.flatnonzero(sizes > SMALL):
        start, size = starts[at], sizes[at]
        own = values[start : start + size]
        label = np.arange(size)
        for x, y in linked(own, own, radius):
            # A block at a time, folded into what is known, so that links are never held all at once.
            label = _smallest_linked(size, np.r_[np.arange(size), x], np.r_[label, y])
        xs.append(np.arange(size) + start)
        ys.append(label + start)
    if not xs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = _smallest_linked(len(values), np.concatenate(xs), np.concatenate(ys))
    found = np.flatnonzero(label != np.arange(len(values)))
    return values[found], values[label[found]]


def near_links(unique: DataFrame, radius: int = 2, tile: int = TILE, count: int | None = None) -> DataFrame:
    """(a, b): edges that connect all distinct `fingerprint`s within the radius of each other, by way of others
    perhaps."""
    chosen = masks(radius, unique.count() if count is None else count)
    keyed = unique.select(
        F.col("fingerprint").alias("f"),
        F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in chosen])).alias("t", "k"),
    )
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["t", "k"]).withColumn("p", F.bit_count("f"))
    # The rows of a bucket above the size of a tile are salted, within their population count.
    salts = F.ceil(F.col("n") / tile).cast("int")
    salt = F.when(salts > 1, F.pmod(F.xxhash64("f"), salts)).otherwise(0).cast("int")
    mine = (F.col("p") * 100_000 + salt).cast("long")
    others = F.flatten(
        F.transform(
            F.sequence(F.col("p") - radius, F.col("p") + radius),
            lambda q: F.transform(F.sequence(F.lit(0), salts - 1), lambda s: (q * 100_000 + s).cast("long")),
        )
    )
    pairs = F.when(
        salts > 1,
        F.transform(others, lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"))),
    ).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))))
    dealt = met.select("t", "k", "f", "p", F.explode(pairs).alias("pair")).select(
        F.xxhash64("t", "k", "pair.x", "pair.y").alias("g"), "t", "k", "pair.x", "pair.y", "p", "f"
    )
    ordered = dealt.repartition("g").sortWithinPartitions("g", "t", "k", "x", "y", "p", "f").select("t", "k", "x", "y", "f")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def edges(table: pa.Table) -> pa.RecordBatch:
            columns = [table.column(i).to_numpy() for i in range(4)]
            change = np.zeros(len(table), bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            values = table.column(4).to_numpy().view(np.uint64)
            a, b = _links(np.cumsum(change), values, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in many_rows(batches):
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            # The last group may go on in the next batch.
            last = len(table) - 1
            keys = [table.column(i).to_numpy() for i in range(4)]
            same = np.ones(len(table), bool)
            for c in keys:
                same &= c == c[last]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = [table.slice(cut)]
            if cut:
                yield edges(table.slice(0, cut))
        if held and len(held[0]):
            yield edges(held[0])

    return ordered.mapInArrow(compare, "a BIGINT, b BIGINT").distinct()


def classes(marked: DataFrame, radius: int = 2) -> DataFrame:
    """(fingerprint, root): each distinct fingerprint with the one that names its component."""
    unique = marked.select("fingerprint").distinct().checkpoint()
    roots = components(near_links(unique, radius))
    return unique.join(roots, unique["fingerprint"] == roots["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root")
    )


def near_duplicates(
    texts: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fingerprint, component_id): every row with the smallest id that links of `radius` bits lead to."""
    shared_folder(texts.sparkSession)
    marked = fingerprints(texts, id, text=text, words=words).checkpoint()
    named = classes(marked, radius).checkpoint()
    first = marked.groupBy("fingerprint").agg(F.min(id).alias("first"))
    smallest = named.join(first, "fingerprint").groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.join(smallest, "root").select(F.col("fingerprint").alias("f"), "component_id")
    return marked.join(label, F.col("fingerprint") == F.col("f")).select(id, "fingerprint", "component_id")


def keep_one(
    texts: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2
) -> DataFrame:
    """All columns of one row of each component: that of the smallest id, and of equal ids the text of the
    smallest hash. A row with an id goes before one without."""
    shared_folder(texts.sparkSession)
    columns = texts.columns
    # Id and text in one key that is never null: rows that agree in it are repeated rows.
    key = F.concat_ws(
        ":",
        F.coalesce(F.lpad(F.col(id).cast("string"), 20, " "), F.lit("none")),
        F.hex(F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))),
    )
    keyed = texts.select(F.struct(*columns).alias("row"), F.col(id).alias("id"), F.col(text).alias("text"), key.alias("key"))
    marked = fingerprints(keyed, "id", "key", words=words).checkpoint()
    named = classes(marked, radius)
    first = marked.groupBy("fingerprint").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    kept = named.join(first, "fingerprint").groupBy("root").agg(F.min("first").alias("first")).select("first.key")
    rows = keyed.select("key", "row").dropDuplicates(["key"])
    return rows.join(kept, "key", "left_semi").select("row.*")
