"""Ordered work per key that stays spread out when one key holds much of the data.

A window over a key puts the whole key into one task. Here a key with more than `max_rows` rows is cut
into chunks of consecutive rows; windows run per (key, chunk), and what a chunk needs from the others
is carried over in one small row per chunk. Data without such a key gets the plain window.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from colloquy.sources.shared import shared_folder

# Rows of one key that one task may sort by itself.
MAX_ROWS = 2_000_000
# Weight of the rows of one key, in bytes as a rule, that one task may sort by itself.
MAX_WEIGHT = 256 << 20
# Rows of a table of keys or of cut points that may be broadcast; a larger one is joined by shuffle. Chunks
# stay as they are, however many there are.
BROADCAST_ROWS = 1_000_000
# Rows looked at per chunk to place its cut.
SAMPLE = 100
CHUNK = "_chunk"


class Chunks(NamedTuple):
    """Cut points of the large keys, or no `bounds` when no key is large.

    `bounds` has one row (_key, _chunk, _from, _to) per chunk, `size` rows in all; `longest` is the most
    chunks of one key.
    """

    key: str
    order: tuple[str, ...]
    bounds: DataFrame | None = None
    size: int = 0
    longest: int = 0
    null_key: bool = False

    @property
    def position(self) -> Column:
        return F.col(self.order[0]) if len(self.order) == 1 else F.struct(*self.order)

    def groups(self, rows: DataFrame) -> list[str]:
        return [self.key, CHUNK] if CHUNK in rows.columns else [self.key]

    def window(self, rows: DataFrame) -> WindowSpec:
        return Window.partitionBy(*self.groups(rows)).orderBy(*self.order)

    def same_key(self, left: Column, right: Column) -> Column:
        # Plain equality lets a join use the partitioning of the windows. Without bounds it is not known whether
        # rows that bring their chunks have a null key.
        unsure = self.null_key or self.bounds is None
        return left.eqNullSafe(right) if unsure else left == right

    def join_chunks(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """Left join of a table with one row per (_key, _number); its measured size picks the strategy."""
        on = self.same_key(F.col(self.key), F.col("_key")) & (F.col(CHUNK) == F.col("_number"))
        return rows.join(table, on, "left").drop("_key", "_number")


class Fold(NamedTuple):
    """One running column: `kind` is total, first, last, lag or lead.

    first and last skip nulls; total, first and last end at the current row, or before it when
    `current` is false.
    """

    kind: str
    column: str
    current: bool = True


def measure(
    rows: DataFrame,
    key: str,
    order: tuple[str, ...],
    max_rows: int | None = None,
    weight: Column | None = None,
    max_weight: int | None = None,
) -> Chunks:
    """Count rows per key and cut the keys above `max_rows`; with a `weight` of each row, such as the bytes of its text,
    those whose rows weigh more than `max_weight` together, at places that leave chunks of about that weight.

    Runs one counting job over the key column. Only if a key is too large, some rows of the large keys are
    looked at to place cuts between them; every row then has its chunk, wherever the cuts are. The result also
    fits any rows derived from `rows` that keep their key and order columns.
    """
    if weight is None:
        max_rows, each = MAX_ROWS if max_rows is None else max_rows, F.lit(1).cast("long")
    else:
        max_rows, each = MAX_WEIGHT if max_weight is None else max_weight, F.greatest(weight.cast("long"), F.lit(1))
    chunks = Chunks(key, tuple(order))
    sizes = rows.groupBy(key).agg(F.sum(each).alias("_rows"))
    seen = _large(sizes, key, max_rows)
    if not seen["keys"]:
        return chunks

    shared_folder(rows.sparkSession)
    chunks = chunks._replace(null_key=seen["null_key"])
    keys = sizes.where(F.col("_rows") > max_rows).select(F.col(key).alias("_key"))
    if seen["keys"] <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    share = min(1.0, SAMPLE / max_rows)
    seen_rows = (
        rows.select(key, *order, each.alias("_each"))
        .join(keys, chunks.same_key(F.col(key), F.col("_key")), "left_semi")
        # A row is looked at as often as it weighs, and stands for those that are not.
        .where(F.rand(17) < F.col("_each") * share)
        .withColumn("_each", F.greatest("_each", F.lit(math.floor(1 / share)).cast("long")))
        .repartitionByRange(int(seen["rows"] * share / 1_000_000) + 1, key, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    so_far = F.sum("_each").over(
        Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    points = (
        seen_rows.withColumn("_to", so_far)
        # A cut where the weight passes a multiple of the most.
        .where(F.floor(F.col("_to") / max_rows) > F.floor((F.col("_to") - F.col("_each")) / max_rows))
        .select(F.col(key).alias("_key"), chunks.position.alias("_from"))
        .distinct()
        # Which rows are looked at may differ between runs of the same plan.
        .checkpoint()
    )
    along = Window.partitionBy("_key").orderBy("_from")
    later = points.select(
        "_key", F.row_number().over(along).alias(CHUNK), "_from", F.lead("_from").over(along).alias("_to")
    )
    none = F.when(F.lit(False), F.min("_from"))
    first = points.groupBy("_key").agg(
        F.lit(0).alias(CHUNK), none.alias("_from"), F.min("_from").alias("_to")
    )
    bounds = first.unionByName(later).checkpoint()
    facts = bounds.agg(F.count("*").alias("size"), F.max(CHUNK).alias("last")).first()
    if not facts["size"]:
        return Chunks(key, tuple(order))
    return chunks._replace(bounds=bounds, size=facts["size"], longest=facts["last"] + 1)


def _large(sizes: DataFrame, key: str, max_rows: int):
    large = F.col("_rows") > max_rows
    return sizes.agg(
        F.count_if(large).alias("keys"),
        F.sum(F.when(large, F.col("_rows"))).alias("rows"),
        F.coalesce(F.bool_or(large & F.col(key).isNull()), F.lit(False)).alias("null_key"),
    ).first()


def assign(rows: DataFrame, chunks: Chunks) -> DataFrame:
    """Rows with their chunk, null for keys that are not cut; unchanged when no key is."""
    if chunks.bounds is None or CHUNK in rows.columns:
        return rows
    return locate(rows, chunks, chunks.bounds, chunks.position, CHUNK)


def locate(
    rows: DataFrame, chunks: Chunks, bounds: DataFrame, at: Column, into: str
) -> DataFrame:
    """Rows with the chunk whose [_from, _to) holds `at`, null where there is none.

    `bounds` has one row per chunk and is broadcast if its counted size allows. The search takes two steps, a
    stretch of chunks and then the chunk, so that a row is compared with about twice the root of its key's
    chunks.
    """
    stretch = math.isqrt(chunks.longest) + 1
    fine = bounds.withColumn("_stretch", F.floor(F.col(CHUNK) / stretch))
    coarse = fine.groupBy("_key", "_stretch").agg(
        F.min_by("_from", CHUNK).alias("_from"), F.max_by("_to", CHUNK).alias("_to")
    )
    inside = (
        chunks.same_key(F.col(chunks.key), F.col("_key"))
        & (F.col("_from").isNull() | (at >= F.col("_from")))
        & (F.col("_to").isNull() | (at < F.col("_to")))
    )
    near = rows.join(small(coarse, chunks).withColumnRenamed("_stretch", "_part"), inside, "left")
    inside = inside & (F.col("_part") == F.col("_stretch"))
    found = near.drop("_key", "_from", "_to").join(
        small(fine, chunks).withColumnRenamed(CHUNK, "_found"), inside, "left"
    )
    return found.withColumn(into, F.col("_found")).drop(
        "_key", "_from", "_to", "_part", "_stretch", "_found"
    )


def small(table: DataFrame, chunks: Chunks) -> DataFrame:
    """A table with at most a row per chunk, broadcast if the counted chunks allow."""
    return F.broadcast(table) if chunks.size <= BROADCAST_ROWS else table


def together(rows: DataFrame, *groups: str) -> DataFrame:
    """Rows with each group in one partition, for a task that walks them.

    By a hash of the groups and not by the groups themselves: Spark leaves out a shuffle that a join below has made
    already, and may deal out the partitions of that join anew while it runs, as it knows of nothing that needs them.
    """
    return rows.repartition(F.xxhash64(*groups))


def released(result: DataFrame, given: DataFrame) -> DataFrame:
    """Drop the chunk column unless the caller brought it."""
    return result if CHUNK in given.columns else result.drop(CHUNK)


def scan(rows: DataFrame, chunks: Chunks, folds: dict[str, Fold]) -> DataFrame:
    """`rows` with one running column per fold, in the order of the chunks."""
    rows = assign(rows, chunks)
    if CHUNK in rows.columns:
        # Read twice below, and shuffled once.
        rows = rows.repartition(*chunks.groups(rows))
    window = chunks.window(rows)
    local = rows.select("*", *[_local(f, window).alias(n) for n, f in folds.items()])
    if CHUNK not in rows.columns:
        return local

    at = chunks.position
    # Rows of keys that are not cut leave first, by a condition that the optimiser does not move: below the shuffle
    # it would make another one of it. For the same reason every column is asked for.
    in_chunks = rows.where(F.col(CHUNK).isNotNull() | (F.rand(0) < 1e-300))
    whole = (
        in_chunks.groupBy(chunks.key, CHUNK)
        .agg(
            F.any_value(chunks.key).alias("_key"),
            F.max(CHUNK).alias("_number"),
            F.max(F.hash(*rows.columns)).alias("_all"),
            *[_summary(f, at).alias(n) for n, f in folds.items()],
        )
        .where(F.col("_number").isNotNull() & F.col("_all").isNotNull())
    )
    along = Window.partitionBy("_key").orderBy("_number")
    carry = whole.select(
        "_key", "_number", *[_carry(f, n, along).alias(f"_carry_{n}") for n, f in folds.items()]
    )
    before = F.lag(chunks.order[0]).over(window).isNull()
    after = F.lead(chunks.order[0]).over(window).isNull()
    edged = local.select("*", before.alias("_head"), after.alias("_tail"))
    return chunks.join_chunks(edged, carry).select(*rows.columns, *[_combined(f, n).alias(n) for n, f in folds.items()])


def _local(fold: Fold, window: WindowSpec) -> Column:
    if fold.kind == "lag":
        return F.lag(fold.column).over(window)
    if fold.kind == "lead":
        return F.lead(fold.column).over(window)
    running = window.rowsBetween(Window.unboundedPreceding, 0 if fold.current else -1)
    if fold.kind == "total":
        return F.sum(fold.column).over(running)
    if fold.kind == "first":
        return F.first(fold.column, ignorenulls=True).over(running)
    return F.last(fold.column, ignorenulls=True).over(running)


def _summary(fold: Fold, at: Column) -> Column:
    """What one chunk tells the others."""
    column = F.col(fold.column)
    if fold.kind == "total":
        return F.sum(column)
    if fold.kind == "lead":
        return F.min_by(column, at)
    if fold.kind == "lag":
        return F.max_by(column, at)
    known = F.when(column.isNotNull(), at)
    return F.min_by(column, known) if fold.kind == "first" else F.max_by(column, known)


def _carry(fold: Fold, name: str, along: WindowSpec) -> Column:
    if fold.kind == "lead":
        return F.lead(name).over(along)
    if fold.kind == "lag":
        return F.lag(name).over(along)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    if fold.kind == "total":
        return F.sum(name).over(earlier)
    if fold.kind == "first":
        return F.first(name, ignorenulls=True).over(earlier)
    return F.last(name, ignorenulls=True).over(earlier)


def _combined(fold: Fold, name: str) -> Column:
    own, carried = F.col(name), F.col(f"_carry_{name}")
    if fold.kind == "total":
        return F.when(own.isNull() & carried.isNull(), None).otherwise(
            F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))
        )
    if fold.kind == "lead":
        return F.when(F.col("_tail"), carried).otherwise(own)
    if fold.kind == "lag":
        return F.when(F.col("_head"), carried).otherwise(own)
    return F.coalesce(carried, own) if fold.kind == "first" else F.coalesce(own, carried)
