"""Near copies: texts whose sets of shingles have a Jaccard similarity of 4/5 or more, none left out.

1.  Texts of equal sets are put together. A shingle counts by 64 bits of hash, a set is named by 64 bits of its hashes.
2.  Sets whose SimHash fingerprints differ in `radius` bits or fewer are candidates, by the exact comparison of `simhash`.
    The similarity asked for is some ten bits wide, so what is further apart is found in another way.
3.  All sets are put in one order of shingles, rare ones first. Of two sets within the similarity, the first shingles,
    a fifth of each set and one more, have one in common; so sets meet in a bucket for each of those.
4.  A bucket is compared tile by tile by xor and bit counts of parity prints: bit b is whether an odd number of
    shingles fall on b, so two prints differ in at most as many bits as their sets in shingles. Pairs that differ in
    more than the similarity allows are no candidates; what is left is passed on as a spanning tree.
5.  Sets that candidates lead to from one another are compared once more by prints of 4096 bits, as the narrow ones say
    little about long texts.
6.  Sets that are still connected are read again, and compared by their shingles themselves.

Steps 3 to 5 only leave out what cannot be similar; the last one decides. Which shingles are rare is estimated from a sample;
the order that comes of it is the same for all sets, and any order gives the same results.

Defined results are those of `simhash`: null and empty texts are equal, a text of fewer words than a shingle is one
shingle, a row with an id goes before one without.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.llm.batches import few_rows, many_rows
from colloquy.llm.components import components, forest
from colloquy.llm.simhash import SEED, fingerprint, near_links
from colloquy.operators.chunks import BROADCAST_ROWS
from colloquy.sources.shared import new_folder, shared_folder


class Settings(NamedTuple):
    words: int = 5
    # The similarity as a fraction, so that it is exact.
    part: int = 4
    whole: int = 5
    # Bits that SimHash fingerprints of candidates may differ in.
    radius: int = 2
    # Sets of one side of a comparison of prints, and shingles of one side of a comparison of sets.
    tile: int = 4096
    shingles: int = 1 << 21
    # Rows of the sample that tells rare shingles from common ones, and how many of those are known.
    sample: int = 10_000
    common: int = 200_000


# Bits of a parity print, and of the wide one that tells long texts apart.
BITS = 512
WIDE = 4096
# Rows of a bucket that is compared with others of its kind at once.
SMALL = 64


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order; words are those of `simhash`."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*[found[k:] for k in range(words)]))
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(found) - words + 1))


def parity(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity print as numbers of 64 bits."""
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray, s: Settings) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if s.whole * len(a) < s.part * len(b):
        return False
    if not len(b):
        return True
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return s.whole * both >= s.part * (len(a) + len(b) - both)


def _may_be(sizes: np.ndarray, prints: np.ndarray, i, j, s: Settings) -> np.ndarray:
    """Whether rows i and j can be similar, by size and by print."""
    a, b = sizes[i], sizes[j]
    fits = s.whole * np.minimum(a, b) >= s.part * np.maximum(a, b)
    apart = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=-1, dtype=np.int64)
    return fits & ((s.whole + s.part) * apart <= (s.whole - s.part) * (a + b))


def group_labels(sizes: np.ndarray, prints: np.ndarray, s: Settings, same: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """For each row of a group the first row of its component. Every pair is compared but those that earlier ones
    already connect, so a group of near copies of one text takes few steps."""
    label = np.arange(len(sizes))
    for i in range(len(sizes) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(others):
            continue
        near = others[_may_be(sizes, prints, i, others, s)]
        if same is not None:
            near = np.array([j for j in near.tolist() if same(i, j)], np.int64)
        if len(near):
            met = np.unique(np.r_[label[i], label[near]])
            label[np.isin(label, met)] = met[0]
    return label


def _candidates(group: np.ndarray, sizes: np.ndarray, prints: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect what may be similar within each group; rows of a group stand together."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rows = np.diff(np.r_[starts, len(group)])
    small = np.repeat(rows <= SMALL, rows)
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, min(SMALL, int(rows.max()))):
        x = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        x = x[_may_be(sizes, prints, x, x + step, s)]
        xs.append(x)
        ys.append(x + step)
    for at in np.flatnonzero(rows > SMALL):
        own = slice(starts[at], starts[at] + rows[at])
        label = group_labels(sizes[own], prints[own], s)
        x = np.flatnonzero(label != np.arange(len(label)))
        xs.append(x + starts[at])
        ys.append(label[x] + starts[at])
    return np.concatenate(xs), np.concatenate(ys)


def _common(keyed: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several rows of a sample have, in order of their hash, and in how many."""
    every = max(1, keyed.count() // s.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 200):
            sets = [shingle_set(t, s.words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    found = (
        keyed.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0)
        .select("text")
        .mapInArrow(run, "h BIGINT")
        .groupBy("h")
        .agg(F.count("*").alias("n"))
        .where("n > 4")
        .orderBy(F.desc("n"), "h")
        .limit(s.common)
        .toArrow()
    )
    hashes, times = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order]


def _name(shingles: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(shingles.tobytes())


def _marked(keyed: DataFrame, s: Settings) -> DataFrame:
    """(id, key, node, size, print, fingerprint): every row with the name, number of shingles, print and SimHash fingerprint
    of its set."""
    id = keyed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            nodes, sizes, prints, bits = [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, s.words)
                nodes.append(_name(own))
                sizes.append(len(own))
                prints.append(parity(own).tobytes())
                bits.append(fingerprint(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int32()),
                    pa.array(prints, pa.binary()),
                    pa.array(np.array(bits, np.uint64).view(np.int64)),
                ],
                ["id", "key", "node", "size", "print", "fingerprint"],
            )

    schema = f"id {id}, key STRING, node BIGINT, size INT, print BINARY, fingerprint BIGINT"
    return keyed.select("id", "key", "text").mapInArrow(run, schema)


def _simhash_links(marked: DataFrame, s: Settings) -> DataFrame:
    """(a, b): edges that connect all sets whose fingerprints are within the radius of each other."""
    named = marked.groupBy("fingerprint").agg(F.min("node").alias("first")).checkpoint()
    equal = marked.join(named, "fingerprint").where(F.col("node") != F.col("first"))
    near = near_links(named.select("fingerprint"), s.radius)
    one, other = (named.select(F.col("fingerprint").alias(f), F.col("first").alias(n)) for f, n in (("a", "x"), ("b", "y")))
    return equal.select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(
        near.join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    )


def _first_shingles(keyed: DataFrame, s: Settings) -> DataFrame:
    """(k, node): the rarest shingles of each set, of which similar sets share one. They are made anew from the
    texts, since they take more room than these."""
    hashes, times = _common(keyed, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 200):
            found: dict[int, np.ndarray] = {}
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, s.words)
                n, node = len(own), _name(own)
                if not n or node in found:
                    continue
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    own = own[np.argsort(np.where(hashes[at] == own, times[at], 0), kind="stable")]
                found[node] = own[: n + 1 + -s.part * n // s.whole]
            if found:
                nodes = np.repeat(np.array(list(found), np.uint64), [len(x) for x in found.values()])
                first = np.concatenate(list(found.values()))
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(nodes.view(np.int64))], ["k", "node"])

    return keyed.select("text").mapInArrow(run, "k BIGINT, node BIGINT")


def _tile_pairs(salts: Column, node: Column) -> Column:
    """The pairs of tiles of its group that a row belongs to."""
    mine = F.pmod(F.xxhash64(node), salts)
    return F.transform(
        F.sequence(F.lit(0).cast("long"), salts - 1),
        lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y")),
    )


def _candidate_links(first: DataFrame, unique: DataFrame, s: Settings) -> DataFrame:
    """(a, b): edges that connect all sets that can be similar."""
    met = (
        first.repartition("k")
        .dropDuplicates(["k", "node"])
        .withColumn("n", F.count("*").over(Window.partitionBy("k")))
        .where("n > 1")
    )
    return _compared(met.join(unique.select("node", "size", "print"), "node"), s)


def _compared(rows: DataFrame, s: Settings) -> DataFrame:
    """(a, b): edges that connect what can be similar by its print, of (k, n, node, size, print) with n rows of equal k."""
    salts = F.ceil(F.col("n") / s.tile).cast("long")
    dealt = rows.withColumn("pair", F.explode(_tile_pairs(salts, F.col("node")))).select(
        "k", "pair.x", "pair.y", "node", "size", "print"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(table: pa.Table, change: np.ndarray) -> pa.RecordBatch:
            prints = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint64).reshape(len(table), -1)
            x, y = _candidates(np.cumsum(change), table.column(4).to_numpy().astype(np.int64), prints, s)
            nodes = table.column(3).to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in many_rows(batches):
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            change = _changes(table)
            # The last group may go on in the next batch.
            cut = int(np.flatnonzero(change)[-1])
            if cut:
                yield edges(table.slice(0, cut), change[:cut])
            held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield edges(table, _changes(table))

    ordered = dealt.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y", "node")
    # Buckets of one group of copies find much the same edges.
    return forest(ordered.mapInArrow(compare, "a BIGINT, b BIGINT"))


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row's first three columns are not those of the row before; true for the first row."""
    change = np.zeros(len(table), bool)
    change[0] = True
    for i in range(3):
        c = table.column(i).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return change


def _told_apart(members: DataFrame, keyed: DataFrame, s: Settings) -> DataFrame:
    """(a, b): edges that connect those members (root, node, size, key) of one root that their wide prints do not tell
    apart. A narrow print says little about a long text, and texts are not to be moved for nothing."""
    sums = members.groupBy("root").agg(F.count("*").alias("n"))
    named = members.join(sums, "root").select("key", F.col("root").alias("k"), "n", "node", "size")
    few = members.count() <= BROADCAST_ROWS
    texts = keyed.select("key", "text").join(F.broadcast(named) if few else named, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 200):
            prints = [parity(shingle_set(t, s.words), WIDE).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints, pa.binary())], [*batch.schema.names[1:], "print"])

    wide = texts.select("text", "k", "n", "node", "size").mapInArrow(run, "k BIGINT, n BIGINT, node BIGINT, size INT, print BINARY")
    return _compared(wide.dropDuplicates(["node"]), s)


def _true_links(members: DataFrame, s: Settings) -> DataFrame:
    """(a, b): edges that connect all similar sets, of (root, node, size, text) where similar ones have one root."""
    sums = members.groupBy("root").agg(F.sum("size").alias("n"))
    dealt = (
        members.join(sums, "root")
        .withColumn("pair", F.explode(_tile_pairs(F.ceil(F.col("n") / s.shingles).cast("long"), F.col("node"))))
        .select("root", "pair.x", "pair.y", "node", "text")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> pa.RecordBatch:
            sizes, prints = np.array([len(x) for x in sets], np.int64), np.stack([parity(x) for x in sets])
            label = group_labels(sizes, prints, s, lambda i, j: similar(sets[i], sets[j], s))
            x = np.flatnonzero(label != np.arange(len(label)))
            own = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[x]), pa.array(own[label[x]])], ["a", "b"])

        now, nodes, sets = None, [], []
        for batch in few_rows(batches):
            for *group, node, text in zip(*[c.to_pylist() for c in batch.columns]):
                if group != now and nodes:
                    yield edges()
                    nodes, sets = [], []
                now = group
                nodes.append(node)
                sets.append(shingle_set(text, s.words))
        if nodes:
            yield edges()

    ordered = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "node")
    return ordered.mapInArrow(compare, "a BIGINT, b BIGINT")


def keep_one(texts: DataFrame, id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """All columns of one row of each component of near copies: that of the smallest id, and of equal ids the text
    of the smallest hash."""
    s = settings
    spark = texts.sparkSession
    shared_folder(spark)
    # Id and text in one key that is never null: rows that agree in it are repeated rows.
    key = F.concat_ws(
        ":",
        F.coalesce(F.lpad(F.col(id).cast("string"), 20, " "), F.lit("none")),
        F.hex(F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))),
    )
    columns = texts.columns
    keyed = texts.select(
        F.struct(*columns).alias("row"), F.col(id).alias("id"), F.col(text).cast("string").alias("text"), key.alias("key")
    )
    folder = new_folder(spark, "near-copies")
    _marked(keyed, s).write.parquet(folder)
    marked = spark.read.parquet(folder)
    unique = marked.groupBy("node").agg(F.first("size").alias("size"), F.first("print").alias("print"))
    chosen = marked.groupBy("node").agg(F.first("size").alias("size"), F.min("key").alias("key"))

    def members_of(links: DataFrame) -> DataFrame:
        roots = components(links)
        return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(chosen, "node").checkpoint()

    found = _candidate_links(_first_shingles(keyed, s), unique, s)
    members = members_of(found.unionByName(_simhash_links(marked, s)))
    members = members_of(_told_apart(members, keyed, s))
    links = components(_true_links(_with_texts(members, keyed), s))
    first = marked.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    root = links.withColumnRenamed("node", "u")
    named = first.join(root, first["node"] == root["u"], "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select("first.key").checkpoint()
    return _without(keyed.select("key", "row"), marked, kept).select("row.*")


def _with_texts(members: DataFrame, keyed: DataFrame) -> DataFrame:
    """(root, node, size, text): one text of each set. Texts of no member stay where they are if the members can be
    broadcast; else both sides are shuffled."""
    few = members.count() <= BROADCAST_ROWS
    found = keyed.select("key", "text").join(F.broadcast(members) if few else members, "key")
    # A key has several rows where a row is repeated; that does no harm to a comparison.
    return found.select("root", "node", "size", "text")


def _without(rows: DataFrame, marked: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of each kept key. Keys that go, and keys of several rows, are few as a rule: then only the latter are
    shuffled with their texts."""
    times = marked.groupBy("key").agg(F.count("*").alias("n"))
    goes = times.join(kept, "key", "left_anti").select("key", F.lit(False).alias("stays"))
    again = times.where("n > 1").join(kept, "key", "left_semi").select("key", F.lit(True).alias("stays"))
    special = goes.unionByName(again).checkpoint()
    if special.count() > BROADCAST_ROWS:
        return rows.join(kept, "key", "left_semi").dropDuplicates(["key"])
    once = rows.join(F.broadcast(special), "key", "left_anti")
    return once.unionByName(rows.join(F.broadcast(special.where("stays")), "key", "left_semi").dropDuplicates(["key"]))
