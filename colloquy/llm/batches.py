"""Arrow batches of few rows, so that what a task makes of one at a time stays small."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

# Rows of a batch sent to a Python worker; both sides hold a batch whole, and Spark's 10,000 texts take tens of MB.
ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def send_few_rows(spark: SparkSession) -> None:
    """From now on the session sends workers batches of `ROWS` rows; a smaller setting stays."""
    # Zero and less are no bound.
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= ROWS:
        spark.conf.set(BATCH_SETTING, ROWS)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def many_rows(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at least, but for the last, of narrow rows that are best looked at together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    give_back()


def give_back() -> None:
    """Gives the system what a task has freed: workers live on, and others of the executor need it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
