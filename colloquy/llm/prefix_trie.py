"""The trie of conversations that begin alike.

A turn is a 16-byte id, made of its role and text; a conversation is the ids of its turns one after the other, big end
first. Adaptive radix trees (`radix_tree`) hold these keys; a trie node is a byte depth at a whole number of
turns.

Keys are cut into blocks of 64 turns. A block hangs below the prefix in front of it, so that the rows of any
conversation are of bounded size. Equal blocks below equal prefixes are counted first; what differs is range
partitioned, however many conversations share a prefix, and every task builds trees of bounded size. A
prefix that lies in several trees is a node of each, and their counts are added up. What sums over subtrees is found by
pointer doubling among the nodes of two or more members, in as many rounds as their depth has binary digits; below
a node of one member there is one leaf and nothing saved.

Defined results: a null role or text is empty; rows of equal turn are ordered by role, then by turn id; repeated rows
are turns like any other; rows without a conversation id are left out; an empty table has no root and gives
no rows; columns other than the four that are read are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.batches import few_rows
from colloquy.llm.radix_tree import Tree
from colloquy.operators.chunks import BROADCAST_ROWS, Fold, measure, scan
from colloquy.sources.shared import new_folder

WIDTH = 16
BLOCK = 64
# Keys of one tree.
KEYS = 50_000
# Rows with one key that a task may join by itself.
HOT = 200_000


def _written(rows: DataFrame, purpose: str) -> DataFrame:
    folder = new_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def numbered_turns(turns: DataFrame, max_rows: int | None = None) -> DataFrame:
    """(conv_id, place, id, words) of turns (conv_id, turn, role, text): place from 0, a turn's id as hex digits.

    Texts are left behind before the shuffle. A conversation above `max_rows` is numbered in chunks.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"),
        F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 2 * WIDTH).alias("id"),
        word_count(text).alias("words"),
        F.lit(1).cast("long").alias("one"),
    )
    order = ("known", "turn", "role", "id")
    counted = scan(slim, measure(slim, "conv_id", order, max_rows), {"place": Fold("total", "one")})
    return counted.select("conv_id", (F.col("place") - 1).alias("place"), "id", "words")


def borrowed_heads(numbered: DataFrame, span: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c with its first turns taken from conversation c - c % span: as many as the checksum of
    c says, less than `most`. A conversation that is left without turns has a row with a null place."""
    lent = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    # Distinct is combined before its shuffle, so a conversation of any length is one row a task.
    all_ids = numbered.select("conv_id").distinct()
    heads = numbered.where((F.col("place") < most - 1) & (F.col("conv_id") % span == 0))
    lengths = heads.groupBy("conv_id").agg(F.count("*").alias("_has")).withColumnRenamed("conv_id", "_from")
    wanted = (
        all_ids.select(F.col("conv_id").alias("_to"), (F.col("conv_id") - F.col("conv_id") % span).alias("_from"), lent.alias("_lent"))
        .join(lengths, "_from", "left")
        .withColumn("_taken", F.least("_lent", F.coalesce("_has", F.lit(0))))
    )
    taken = heads.join(wanted, (F.col("conv_id") == F.col("_from")) & (F.col("place") < F.col("_lent")))
    # Own turns move up where the other conversation is shorter than what is asked of it.
    own = _look_up(numbered.where(F.col("place") >= lent), "conv_id", wanted.select("_to", "_lent", "_taken"), "_to")
    own = own.withColumn("place", F.col("place") - F.col("_lent") + F.col("_taken"))
    none = all_ids.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in numbered.dtypes if c != "conv_id"])
    return (
        own.select(*numbered.columns)
        .unionByName(taken.select(F.col("_to").alias("conv_id"), "place", "id", "words"))
        .unionByName(none)
    )


def _name(*parts: Column) -> Column:
    """Sixteen bytes that stand for a sequence of turns."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 2 * WIDTH))


def _blocks(sequences: DataFrame, max_rows: int | None) -> DataFrame:
    """(conv_id, block, state, top, key, words, last): a row per block of turns.

    `state` stands for all turns before the block and `top` is the name of the node they lead to; both are made of sums
    over the blocks before, which are found in chunks where a conversation has many.
    """
    turn = F.struct("place", "id", "words")
    blocks = sequences.groupBy(
        "conv_id", F.coalesce(F.floor(F.col("place") / BLOCK), F.lit(0)).cast("long").alias("block")
    ).agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), turn))).alias("turns"))
    parts = F.transform("turns", lambda t: t["id"])
    keyed = blocks.select(
        "conv_id",
        "block",
        F.unhex(F.array_join(parts, "")).alias("key"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
        *[F.xxhash64(F.lit(i), "block", F.array_join(parts, "")).cast("decimal(20,0)").alias(f"_h{i}") for i in (1, 2)],
    )
    # A block is read again for its sums, the check of its size, and its neighbours.
    keyed = _written(keyed, "turn-blocks")
    chunks = measure(keyed, "conv_id", ("block",), max_rows)
    folds = {f"_s{i}": Fold("total", f"_h{i}") for i in (1, 2)}
    summed = scan(keyed, chunks, folds)
    before = [(F.col(f"_s{i}") - F.col(f"_h{i}")).cast("decimal(38,0)").cast("string") for i in (1, 2)]
    state = F.when(F.col("block") == 0, F.lit(b"")).otherwise(_name(F.concat_ws(":", F.col("block").cast("string"), *before).cast("binary")))
    stated = summed.withColumn("state", state).withColumn("_end", _name(F.col("state"), F.col("key")))
    linked = scan(stated, chunks, {"_before": Fold("lag", "_end"), "_after": Fold("lead", "_end")})
    return linked.select(
        "conv_id",
        "block",
        "state",
        F.coalesce("_before", _name(F.lit(b""))).alias("top"),
        "key",
        "words",
        F.col("_after").isNull().alias("last"),
    )


NODES = "node BINARY, parent BINARY, depth BIGINT, words BIGINT, n_convs BIGINT, conv_id BIGINT"


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of rows that come in order of (state, key); what is made of one tree goes out before the next begins."""
    now, tree, words, held = None, Tree(), {}, 0

    def nodes() -> pa.RecordBatch:
        state, top, block = now
        out: dict[str, list] = {name.split()[0]: [] for name in NODES.split(", ")}

        def emit(node: bytes, parent: bytes | None, depth: int, own: int, count: int, least: int) -> None:
            for column, value in zip(out.values(), (node, parent, depth, own, count, least)):
                column.append(value)

        # Digest and name of the deepest whole turn on the way to the node at hand, and what is over, by byte depth.
        way: list[tuple[int, object, bytes, bytes]] = []
        for step in tree.walk():
            while way and way[-1][0] > step.at:
                way.pop()
            if way:
                _, digest, name, rest = way[-1]
            else:
                digest, name, rest = hashlib.sha256(state), top, b""
                if block == 0:
                    emit(top, None, 0, 0, step.count, step.least)
            path, at = rest + step.added, step.at - len(rest)
            while len(path) >= WIDTH:
                turn, path, at = path[:WIDTH], path[WIDTH:], at + WIDTH
                digest = digest.copy()
                digest.update(turn)
                above, name = name, digest.digest()[:WIDTH]
                emit(name, above, block * BLOCK + at // WIDTH, words[turn], step.count, step.least)
            way.append((step.at + len(step.added), digest, name, path))
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds)], list(out))

    for batch in few_rows(batches):
        for state, top, block, key, counts, n, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if now != (state, top, block) or held == KEYS:
                if held:
                    yield nodes()
                now, tree, words, held = (state, top, block), Tree(), {}, 0
            tree.add(key, n, conv)
            words.update(zip((key[i : i + WIDTH] for i in range(0, len(key), WIDTH)), counts))
            held += 1
    if held:
        yield nodes()


def _look_up(rows: DataFrame, key: str, table: DataFrame, at: str) -> DataFrame:
    """Inner join of many rows with a table of one row per key; keys of very many rows are joined where they are."""
    hot = rows.groupBy(key).count().where(F.col("count") > HOT).select(key)
    many = hot.count()
    if not many or many > BROADCAST_ROWS:
        return rows.join(table.withColumnRenamed(at, key), key)
    hot_table = table.join(F.broadcast(hot.withColumnRenamed(key, at)), at, "left_semi").withColumnRenamed(at, key)
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(table.withColumnRenamed(at, key), key)
    # At most as many rows as the keys counted above.
    return rest.unionByName(rows.join(F.broadcast(hot_table), key))


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) of (node, parent, leaves, saved): own values and those of all nodes below.

    After round k a node has the sum over the 2**k levels from its own on, and knows the node 2**k levels above.
    """
    now = _written(shared.select("node", F.col("parent").alias("above"), "leaves", "saved"), "trie-sums")
    while not now.where(F.col("above").isNotNull()).isEmpty():
        known = now.where(F.col("above").isNotNull())
        sums = known.groupBy("above").agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        further = _look_up(
            known.select("node", F.col("above").alias("via")), "via", now.select(F.col("node").alias("at"), "above"), "at"
        ).select("node", F.col("above").alias("_further"))
        added = now.join(sums.withColumnRenamed("above", "node"), "node", "left").join(further, "node", "left")
        now = _written(
            added.select(
                "node",
                F.col("_further").alias("above"),
                (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
            ),
            "trie-sums",
        )
    return now.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each node, which come in order; they are streamed, so a node may have any number."""
    now, digest, done = None, None, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
            ["node", "ends_sha256"],
        )

    for batch in batches:
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node == now:
                digest.update(b",%d" % conv)
                continue
            if now is not None:
                done.append((now, digest.hexdigest()))
            now, digest = node, hashlib.sha256(b"%d" % conv)
        if done:
            yield rows()
            done.clear()
    if now is not None:
        done.append((now, digest.hexdigest()))
        yield rows()


def trie(sequences: DataFrame, max_rows: int | None = None) -> DataFrame:
    """A row per node of the trie of `sequences`, which has (conv_id, place, id, words) a turn and may have rows with a
    null place for conversations without turns.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member,
    the number of turns, the parent's smallest member, members, children, childless nodes at or below, words that
    members need not repeat at or below, and the digest of the ids of those that end here.
    """
    blocks = _written(_blocks(sequences, max_rows), "trie-blocks")
    distinct = blocks.groupBy("state", "top", "block", "key").agg(
        F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id")
    )
    # Range partitioning looks at its input first.
    distinct = _written(distinct.select("state", "top", "block", "key", "words", "n", "conv_id"), "trie-keys")
    spread = distinct.repartitionByRange("state", "key").sortWithinPartitions("state", "key")
    partial = spread.mapInArrow(_grow, NODES)
    nodes = _written(
        partial.groupBy("node", "depth").agg(
            F.first("parent").alias("parent"),
            F.first("words").alias("words"),
            F.sum("n_convs").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
        ),
        "trie-nodes",
    )
    alone = F.col("n_convs") == 1
    children = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.count("*").alias("n_children"), F.count_if(alone).alias("_alone")
    )
    children = children.withColumnRenamed("parent", "node")
    parents = _look_up(
        nodes.where(F.col("parent").isNotNull()).select("node", "parent"),
        "parent",
        nodes.select(F.col("node").alias("_at"), F.col("conv_id").alias("parent_conv_id")),
        "_at",
    ).select("node", "parent_conv_id")
    counted = nodes.join(children, "node", "left").withColumns(
        {"n_children": F.coalesce("n_children", F.lit(0)), "_alone": F.coalesce("_alone", F.lit(0))}
    )
    sums = _subtree_sums(
        counted.where(~alone).select(
            "node",
            "parent",
            (F.col("_alone") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        )
    )
    ends = (
        blocks.where("last")
        .select(F.when(F.col("key") == F.lit(b""), F.col("top")).otherwise(_name("state", "key")).alias("node"), "conv_id")
        .repartition("node")
        .sortWithinPartitions("node", "conv_id")
        .mapInArrow(_digests, "node BINARY, ends_sha256 STRING")
    )
    joined = counted.join(parents, "node", "left").join(sums, "node", "left").join(ends, "node", "left")
    return joined.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
