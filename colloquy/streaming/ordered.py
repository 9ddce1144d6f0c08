"""Rows of a stream walked in the order of their time, key by key, whatever the order they arrive in.

Rows wait in the state of their key until the watermark has passed their time; then no earlier row can come that is not
late, and they are walked in order with what the key remembers. So a stream gives what a table gives. Rows that
come after the watermark are not walked: they go out by themselves, marked `late`.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE, PENDING = "state", "pending"
# Rows of a frame that goes out.
FRAME = 10_000


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, which these jobs need; the setting of the session is
    put back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Walk(ABC):
    """What happens to the rows of a key in order. `state` and `out` are schemas; a row is a tuple (at, *order, *values)
    with `at` in microseconds."""

    state: str
    out: str

    @abstractmethod
    def start(self) -> tuple:
        """The state before the first row."""

    @abstractmethod
    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        """The state after a row, and what goes out."""

    @abstractmethod
    def late(self, row: tuple) -> tuple:
        """What goes out for a row that came too late."""

    def finish(self, state: tuple) -> list[tuple]:
        """What goes out when a key has been silent for long enough."""
        return []

    def forgets(self, state: tuple, watermark: int) -> bool:
        """Whether rows from the watermark on go the same way from the start state as from this one."""
        return False


def _tuples(frame: pd.DataFrame) -> list[tuple]:
    """Rows with None for what is missing."""
    return list(zip(*[[None if v is pd.NA or v != v else v for v in frame[c].tolist()] for c in frame.columns]))


class InOrder(StatefulProcessor):
    def __init__(self, walk: Walk, rows: T.StructType, names: Sequence[str], silence: int | None):
        self.walk, self.rows, self.names, self.silence = walk, rows, list(names), silence
        # Schemas are read on the driver, as that takes a session.
        self.fields = T.StructType.fromDDL(walk.state).names
        self.columns = ["session", *T.StructType.fromDDL(walk.out).names, "late"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState(PENDING, self.rows)
        self.state = handle.getValueState(STATE, self.walk.state)
        self.last = handle.getValueState("last", "at BIGINT")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in _tuples(initialState[self.fields]):
            self.state.update(row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for frame in rows:
            given = _tuples(frame[self.rows.names])
            # Before there is a watermark nothing is late.
            late = [r for r in given if watermark and r[0] < watermark]
            yield from self._frames(key, [(*self.walk.late(r), True) for r in late])
            waiting = [r for r in given if not watermark or r[0] >= watermark]
            if waiting:
                self.pending.appendList(waiting)
                least = min(r[0] for r in waiting)
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(self._after(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        due, waiting = [], []
        if self.pending.exists():
            for row in self.pending.get():
                (due if row[0] < watermark else waiting).append(tuple(row))
        state = self.state.get() if self.state.exists() else None
        out: list[tuple] = []
        if due:
            due.sort(key=lambda r: r[: len(self.names)])
            state = self.walk.start() if state is None else tuple(state)
            for row in due:
                state, said = self.walk.step(state, row)
                out += [(*s, False) for s in said]
                if len(out) >= FRAME:
                    yield from self._frames(key, out)
                    out = []
            self.last.update((due[-1][0],))
            if waiting:
                self.pending.put(waiting)
            else:
                self.pending.clear()
        if waiting:
            self.handle.registerTimer(self._after(min(r[0] for r in waiting)))
        elif state is not None and self.silence is not None and self.last.exists():
            until = self.last.get()[0] + self.silence
            if until < watermark:
                out += [(*s, False) for s in self.walk.finish(tuple(state))]
                state = None
            else:
                self.handle.registerTimer(self._after(until))
        if state is None or self.walk.forgets(tuple(state), watermark):
            self.state.clear()
            self.last.clear()
        elif due:
            self.state.update(state)
        yield from self._frames(key, out)

    @staticmethod
    def _after(at: int) -> int:
        """The first millisecond that is after a time in microseconds."""
        return at // 1000 + 1

    def _frames(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(out), FRAME):
            part = [(key[0], *r) for r in out[at : at + FRAME]]
            yield pd.DataFrame(part, columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


def microseconds(rows: DataFrame, name: str) -> Column:
    """A time as BIGINT, in microseconds; an integer is taken for such."""
    time = F.col(name)
    kind = rows.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(time)
    if isinstance(kind, T.TimestampNTZType):
        # From its parts, which unlike a cast to TIMESTAMP do not depend on the session time zone.
        minutes = F.unix_date(time.cast("date")).cast("bigint") * 1440 + F.hour(time) * 60 + F.minute(time)
        seconds = F.extract(F.lit("SECOND"), time)
        return minutes * 60000000 + (seconds * 1000000).cast("bigint")
    return time.cast("bigint")


def walk_in_order(
    rows: DataFrame,
    walk: Walk,
    key: str,
    time: str,
    order: Sequence[str],
    values: dict[str, Column],
    delay: str,
    silence: int | None = None,
    marks: DataFrame | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """(key, what the walk says, late) for the rows of a stream, in append mode.

    Rows may come up to `delay` after later ones; (time, *order) must not be null and must be unique within a key.
    `silence`, in microseconds, ends a key that has had no row for so long: the walk says its last and the state goes.
    Without it the state of a key is kept until the walk does without.

    `marks` is a stream of one column of timestamps: nothing that is earlier will come. It lets the last rows of a log out,
    behind which no row would move the watermark. `initial` has a row (key, *state) for keys that begin with a state
    that was found otherwise. A task holds the waiting rows of a key, those of about `delay`.
    """
    picked = rows.select(
        F.col(key).alias("session"),
        microseconds(rows, time).alias("at"),
        *[F.col(o).alias(f"order{i}") for i, o in enumerate(order)],
        *[c.alias(n) for n, c in values.items()],
    )
    kept = picked.columns
    timed = picked.withColumn("_time", F.timestamp_micros("at")).withColumn("_mark", F.lit(False))
    if marks is not None:
        told = marks.select(F.col(marks.columns[0]).cast("timestamp").alias("_time"), F.lit(True).alias("_mark"))
        timed = timed.unionByName(told, allowMissingColumns=True)
    # Marks leave behind the watermark, so the condition names its column. That column goes too, as Spark would drop late rows
    # by it.
    marked = timed.withWatermark("_time", delay)
    live = marked.where(~F.col("_mark") | F.col("_time").isNull()).select(*kept)
    schema = T.StructType([live.schema[c] for c in kept[1:]])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    out = T.StructType(
        [
            T.StructField("session", rows.schema[key].dataType),
            *T.StructType.fromDDL(walk.out).fields,
            T.StructField("late", T.BooleanType()),
        ]
    )
    started = None if initial is None else initial.withColumnRenamed(key, "session").groupBy("session")
    return (
        live.groupBy("session")
        .transformWithStateInPandas(
            InOrder(walk, schema, kept[1 : 2 + len(order)], silence),
            out,
            outputMode="Append",
            timeMode="EventTime",
            initialState=started,
        )
        .withColumnRenamed("session", key)
    )


def kept_state(spark: SparkSession, progress: str, key: str, walk: Walk) -> DataFrame:
    """(key, *state) of every key that a stopped stream remembers, read from its progress folder: what another stream, or a
    job over a table, may go on from. Rows that still wait are not in it, see `waiting_rows`."""
    stored = spark.read.format("statestore").option("stateVarName", STATE).load(progress)
    names = T.StructType.fromDDL(walk.state).names
    return stored.select(F.col("key.session").alias(key), *[F.col(f"value.{n}").alias(n) for n in names])


def waiting_rows(spark: SparkSession, progress: str, key: str) -> DataFrame:
    """The rows that wait for the watermark in a stopped stream."""
    stored = spark.read.format("statestore").option("stateVarName", PENDING).load(progress)
    return stored.select(F.col("key.session").alias(key), "list_element.*")
