"""Admission on a live log of sends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.admission import FOREVER, NEVER, check_times
from colloquy.streaming.ordered import Walk, microseconds, walk_in_order


class AdmissionWalk(Walk):
    """Remembers the time from which a key is free again."""

    state = "free BIGINT"

    def __init__(self, id_type: str = "BIGINT"):
        self.out = f"send {id_type}, admitted BOOLEAN"

    def start(self) -> tuple:
        return (NEVER,)

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        begin, send, finish = row
        admitted = begin >= state[0]
        return (finish,) if admitted else state, [(send, admitted)]

    def late(self, row: tuple) -> tuple:
        return (row[1], None)

    def forgets(self, state: tuple, watermark: int) -> bool:
        # All sends to come start when the key is free.
        return state[0] <= watermark


def _finish(sends: DataFrame, start: str, end: str) -> Column:
    return F.greatest(microseconds(sends, start), F.coalesce(microseconds(sends, end), F.lit(FOREVER)))


def admit_stream(
    sends: DataFrame,
    key: str = "key",
    start: str = "start",
    end: str = "end",
    id: str = "id",
    delay: str = "0 seconds",
    silence: int | None = None,
    marks: DataFrame | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """(id, key, admitted, late) for each send of a stream, in append mode; verdicts are those of `admit_sends`.

    Sends may arrive up to `delay` after ones that start later. One that comes after that goes out `late` with no verdict.
    Integer times are microseconds. A key that is free is forgotten; one with a send that never ends is remembered for
    good, or with `silence` until it has had no send for so many microseconds. For `marks` and `initial` see
    `walk_in_order`; `admission_state` makes the latter.
    """
    check_times(sends, start, end)
    walk = AdmissionWalk(sends.schema[id].dataType.simpleString())
    values = {"finish": _finish(sends, start, end)}
    decided = walk_in_order(sends, walk, key, start, [id], values, delay, silence, marks, initial)
    return decided.select(F.col("send").alias(id), key, "admitted", "late")


def admission_state(admitted: DataFrame, key: str = "key", start: str = "start", end: str = "end") -> DataFrame:
    """(key, free) of what `admit_sends` gave: the state a stream begins with that goes on from a table. Admitted sends
    do not overlap, so the key is free when the last of their ends has come."""
    finish = F.when(F.col("admitted"), _finish(admitted, start, end))
    return admitted.groupBy(key).agg(F.max(finish).alias("free"))
