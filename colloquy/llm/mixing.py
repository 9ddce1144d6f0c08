"""A mix of sources by weight: which documents to take, and how often.

Sizes are words. A source's target is its share of all words by weight, three times its own words at the most; what
others cannot give is shared anew. A source is taken whole as often as its target holds it, and for the rest documents
are gone through in the order of a hash, each taken that still fits. No document is sorted for that: words are summed
by source and bucket of the hash, the bucket in which the budget ends is found, and only that bucket is split into
finer ones, until the budget ends at one hash. The document there is left out, and what is left of the budget goes to the
ones behind it that are no larger, until a thousandth of the target or no such document is left. Where a larger part
is left, the one document is added that brings the source nearest to its target. So a document is taken or not by
its hash, its size and a few thresholds of its source, whatever the order of rows.

Defined results: a null text has no words; sources compare by code point and null is a source, the last one; rows of
equal id and text have equal hashes and are taken alike; a source without words has target 0; an empty table gives no
rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.operators.chunks import BROADCAST_ROWS
from colloquy.sources.shared import new_folder

# The most often that a document is taken.
REPEATS = 3
# A budget is met when no more than this part of the target is left: one in so many.
NEAR = 1000
BITS = 60
# Bits of the hash by which a bucket is split, so the most buckets of a source that one task looks along.
SPLIT = 15
# Parts of a source when there are too many sources to broadcast.
PARTS = 32
SPANS = "array<struct<after: bigint, before: bigint, most: bigint>>"


def _written(rows: DataFrame, purpose: str) -> DataFrame:
    folder = new_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def sized(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, hash): all that the mix needs to know of a document."""
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.concat(F.coalesce(F.col(id).cast("string"), F.lit("none")), F.lit(":"), words)
    return documents.select(
        F.col(id).alias("id"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(words, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long").alias("hash"),
    )


def sources_of(sizes: DataFrame) -> DataFrame:
    """(source, source_size), written, as several passes start from it."""
    return _written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")


def weights_in_turn(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """`sources` with a weight each, dealt in the order of their names; they may be any number."""
    order = F.col("source").asc_nulls_last()
    ordered = sources.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    ranked = _written(ordered.withColumn("_nth", nth), "mix-ranks")
    # A row per part.
    parts = ranked.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_nth") - 1) % len(weights) + 1
    weight = F.element_at(F.array(*map(F.lit, weights)), place.cast("int"))
    return ranked.join(offsets, "_part").withColumn("weight", weight).drop("_part", "_nth", "_before")


def targets(weighted: DataFrame) -> DataFrame:
    """(source, source_size, weight, target): all words shared by weight among the sources that are not at their limit.

    A round shares anew what sources at their limit cannot take; a source stays there, as shares only grow.
    """
    weighted = _written(weighted, "mix-weights")
    limit = F.col("source_size") * REPEATS
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    rest, shares, full = total, weighted.agg(F.sum("weight")).first()[0] or 1, 0
    while True:
        # A bigint, as an int times an int weight overflows from two billions on.
        share = F.expr(f"{rest}L") * F.col("weight") / F.lit(shares)
        over = share > limit
        now = weighted.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, limit)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if now[0] == full or not now[2]:
            return weighted.withColumn("target", F.when(over, limit.cast("double")).otherwise(share))
        full, rest, shares = now[0], total - now[1], now[2]


def _by_source(rows: DataFrame, table: DataFrame, count: int) -> DataFrame:
    """Inner join with a table of one row per source; null is a source. A table that is too large to broadcast is copied
    for every part of a source, so that a large source is no single task's."""
    named = table.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(named), same).drop("_source")
    spread = named.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    parted = rows.withColumn("_own", F.pmod(F.col("hash"), F.lit(PARTS)).cast("int"))
    return parted.join(spread, same & (F.col("_own") == F.col("_of"))).drop("_source", "_own", "_of")


def _taken() -> Column:
    inside = F.exists(
        "spans", lambda s: (F.col("hash") > s["after"]) & (F.col("hash") < s["before"]) & (F.col("size") <= s["most"])
    )
    return inside | (F.col("hash") == F.coalesce("extra", F.lit(-1)))


def _end_of_budget(sizes: DataFrame, open_: DataFrame, count: int) -> DataFrame:
    """(source, before, under): the hash at which the budget `left` of each source ends, and the words in front of it;
    sources whose documents all fit have none."""
    fits = (F.col("hash") > F.col("after")) & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
    state = open_.select("source", "after", "left", F.lit(0).cast("long").alias("under"), F.lit(0).cast("long").alias("bucket"))
    shift, most, ended = BITS, None, None
    while shift:
        # With few documents in every bucket each hash is a bucket of its own.
        finer = 0 if most is not None and most <= 2**SPLIT else max(0, shift - SPLIT)
        inside = _by_source(sizes, state, count).where(fits & (F.shiftright("hash", shift) == F.col("bucket")))
        if most is None and finer:
            # The first pass does not know yet how many there are.
            most = inside.groupBy("source").count().agg(F.max("count")).first()[0] or 0
            finer = 0 if most <= 2**SPLIT else finer
        sums = inside.groupBy("source", F.shiftright("hash", finer).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.any_value("left").alias("left"),
            F.any_value("after").alias("after"), F.any_value("under").alias("under"),
        )
        along = Window.partitionBy("source").orderBy("bucket")
        so_far = sums.withColumn("to", F.col("under") + F.sum("words").over(along))
        found = so_far.where(F.col("to") > F.col("left")).groupBy("source", "left", "after").agg(
            F.min_by(F.struct("bucket", (F.col("to") - F.col("words")).alias("under"), "rows"), "bucket").alias("at")
        )
        state = _written(found.select("source", "after", "left", "at.*"), "mix-buckets")
        most = state.agg(F.max("rows")).first()[0]
        if most is None:
            break
        state = state.drop("rows")
        shift = finer
    return state.select("source", F.col("bucket").alias("before"), "under")


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, spans, extra): how often a source is taken whole, and which hashes and sizes
    once more. `sizes` is read several times, `wanted` is what `targets` gives."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    now = _written(
        wanted.withColumn("whole", whole).select(
            "source", "source_size", "target", "whole", left.alias("left"), F.lit(-1).cast("long").alias("after"),
            F.lit(False).alias("over"), F.expr(f"cast(array() as {SPANS})").alias("spans"), F.lit(None).cast("long").alias("extra"),
        ),
        "mix-thresholds",
    )
    count = now.count()
    going = ~F.col("over") & (F.col("left") * NEAR > F.col("target"))
    while not now.where(going).isEmpty():
        open_ = now.where(going)
        ends = _end_of_budget(sizes, open_, count)
        # A source whose documents all fit is done; its words are summed as its last ones are taken.
        fits = (F.col("hash") > F.col("after")) & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
        rest = _by_source(sizes, open_.select("source", "after", "left"), count).where(fits).groupBy("source").agg(
            F.sum("size").alias("all")
        )
        a, b = ends.withColumnRenamed("source", "_a"), rest.withColumnRenamed("source", "_b")
        both = now.join(a, F.col("source").eqNullSafe(F.col("_a")) & F.col("under").isNotNull(), "left").join(
            b, F.col("source").eqNullSafe(F.col("_b")) & F.col("all").isNotNull(), "left"
        )
        added = F.coalesce("under", "all", F.lit(0))
        span = F.struct(
            F.col("after").alias("after"), F.coalesce("before", F.lit(2**BITS)).alias("before"), F.col("left").alias("most")
        )
        now = _written(
            both.select(
                "source", "source_size", "target", "whole",
                F.when(going, F.col("left") - added).otherwise(F.col("left")).alias("left"),
                F.when(going, F.coalesce("before", F.lit(2**BITS))).otherwise(F.col("after")).alias("after"),
                F.when(going, F.col("before").isNull()).otherwise(F.col("over")).alias("over"),
                F.when(going, F.concat("spans", F.array(span))).otherwise(F.col("spans")).alias("spans"), "extra",
            ),
            "mix-thresholds",
        )
    short = now.where(F.col("left") * NEAR > F.col("target"))
    near = F.abs(F.col("words") - F.col("left"))
    extra = (
        _by_source(sizes, short.select("source", "spans", "extra", "left"), count)
        .where(~_taken() & (F.col("size") > 0))
        .groupBy("source", "hash", "left")
        .agg(F.sum("size").alias("words"))
        .where(F.col("words") < 2 * F.col("left"))
        .groupBy("source")
        .agg(F.min_by("hash", F.struct(near, "hash")).alias("_extra"))
        .withColumnRenamed("source", "_source")
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("_extra").isNotNull()
    return now.join(extra, same, "left").select(
        "source", "source_size", "target", "whole", "spans", F.col("_extra").alias("extra")
    )


def taken(sizes: DataFrame, bounds: DataFrame) -> DataFrame:
    """(id, source, size, source_size, target, repeats): how often each document is in the mix, 0 to 3 times."""
    bounds = _written(bounds, "mix-bounds")
    joined = _by_source(sizes, bounds, bounds.count())
    repeats = F.col("whole") + F.when((F.col("size") > 0) & _taken(), 1).otherwise(0)
    return joined.select("id", "source", "size", "source_size", "target", repeats.alias("repeats"))


def mix(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """What `taken` gives for documents, with `weights` as (source, weight), or dealt in turn."""
    sizes = _written(sized(documents, id, text, source), "mix-sizes")
    sources = sources_of(sizes)
    if weights is None:
        weighted = weights_in_turn(sources)
    else:
        named = weights.select(F.col("source").alias("_source"), "weight")
        weighted = sources.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return taken(sizes, thresholds(sizes, targets(weighted))).withColumnRenamed("id", id)
