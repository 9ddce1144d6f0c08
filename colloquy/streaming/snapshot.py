"""Session snapshots kept up to date on a stream of exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from colloquy.operators.session import session_snapshot
from colloquy.operators.turns import TURN_KEY
from colloquy.sources.store import Store

# Sets of changes that a read looks at besides the base, unless a merge comes before.
CHANGES = 16


def keep_snapshots(
    exchanges: DataFrame,
    path: str,
    checkpoint: str,
    key: str = TURN_KEY,
    buckets: int = 32,
    changes: int = CHANGES,
    **options,
) -> DataStreamWriter:
    """Writer of the snapshot of each session that a micro-batch changes, into the store at `path`.

    Exchanges may arrive in any order, as state keeps (turn, value) pairs. The aggregation combines
    before its shuffle, so a busy session sends one row per task. A micro-batch that is repeated counts once. A query
    with a new progress folder is a writer of its own, whose rows are newer than all that the store holds. After
    `changes` micro-batches the store is merged; `compact_snapshots` may do so before, at any time.
    """

    def write(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        # The query's own id, which it keeps with its progress folder.
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        store = Store(spark, path)
        store.append(changed, key, writer, batch, buckets)
        if len(store.manifest()["changes"]) >= changes:
            store.merge(key)

    return (
        session_snapshot(exchanges, key=key, **options)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )


def latest_snapshots(spark: SparkSession, path: str, key: str = TURN_KEY) -> DataFrame:
    """The last snapshot written of each session: one set of files and the few changes since it was merged, however many
    micro-batches there were."""
    rows = Store(spark, path).read(key)
    if rows is None:
        raise ValueError(f"nothing was written to {path}")
    return rows


def compact_snapshots(spark: SparkSession, path: str, key: str = TURN_KEY) -> bool:
    """Merges the changes into one set of files; streams and readers may go on meanwhile. Should this break off, the store
    is what it was. Returns whether there was something to merge and no other merge was faster."""
    return Store(spark, path).merge(key)
