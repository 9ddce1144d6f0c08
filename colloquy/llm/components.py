"""Connected components of a graph of any size, by stars.

Edges are turned in rounds towards the smallest node that either end knows of, until every component is a star
around its smallest node. A round sends each edge a few times; nothing is gathered per node but its smallest
neighbour, which is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.sources.shared import shared_folder


# Edges that a task of a round reads at least, but for the last one.
TASK_EDGES = 20_000


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; roots themselves have no row.

    Runs a job per round. Null ends and loops are ignored, repeated edges count once, no edges give no rows.
    """
    shared_folder(edges.sparkSession)
    now = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
        .checkpoint()
    )
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not sums[0] or tuple(sums) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(sums)
        # Few edges are not worth a task for each partition of the last shuffle.
        now = now.coalesce(sums[0] // TASK_EDGES + 1)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node that has smaller neighbours is not the smallest itself.
        least = _smallest(both).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _smallest(large)
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(least.withColumnRenamed("m", "v")).distinct().checkpoint()


# Edges that a task looks at together.
EDGES = 1 << 20


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes that are not the smallest."""
    nodes, ends = np.unique(np.r_[u, v], return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[u], root[v])
        now = root.copy()
        # Both the ends and what they hang on move to the lesser root.
        for at in (u, v, root[u], root[v]):
            np.minimum.at(now, at, least)
        now = now[now]
        if np.array_equal(now, root):
            moved = root != np.arange(len(root))
            return nodes[moved], nodes[root[moved]]
        root = now


def forest(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Fewer edges of the same components, (a, b) of BIGINT: edges are dealt by their smaller end, and of those that a task
    holds at a time one less than nodes stays for each component. One shuffle; loops and null ends go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            us, vs = spanning(*(np.concatenate(c) for c in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["a", "b"])

        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= EDGES:
                yield stars()
                held, size = [], 0
        if held:
            yield stars()

    ends = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")
    )
    return ends.repartition("b").mapInArrow(run, "a BIGINT, b BIGINT")
