"""Which sends get through while only one per key may be pending.

A send is admitted when it starts no earlier than the end of the last admitted send of its key. What
happens to a row depends on all earlier decisions, so rows are walked in order, a key per task.

A key too large for one task is cut into chunks. A chunk is a function from the time at which it finds
the key free to the time at which it leaves it free, and that function is tabulated per chunk, in
parallel. The few distinct times at which chunks leave their key are then linked to the chunk where each
is next felt, and the links are followed from the first chunk on, in one pass per key, or by pointer
doubling where a key has too many links for one task. This gives every chunk its true entry time, and the
ordinary walk runs per chunk.

Some sends may be forced: they go out whatever is pending, so that several can be. Which one ends first then frees
the key, for all of them. What a chunk leaves is no function of one time any more; so all chunks are walked at once as
if nothing were pending before them, and those that another one leaves something to are walked again. A chunk in which the
key is free once, with nothing pending, hands on what it did before. Where chunks still find something new after
that, something is out for longer than a chunk: they are walked in stretches of ever more chunks, in the end a key as a
whole. Rows are streamed, and what a task holds is what is out.
"""

from __future__ import annotations

from heapq import heappop, heappush
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from colloquy.operators.chunks import CHUNK, Chunks, Fold, assign, locate, measure, scan, small, together

FOREVER = 2**63 - 1
# Links of one key that one task follows; beyond that they are followed by doubling.
MAX_LINKS = 2_000_000
NEVER = -FOREVER
# Times that stretches of one width are walked again before they are made wider, and by how much.
ROUNDS, WIDER = 2, 16
STRETCH = "_stretch"


def check_times(sends: DataFrame, start: str, end: str) -> None:
    kinds = [sends.schema[start].dataType, sends.schema[end].dataType]
    timed = (T.TimestampType, T.TimestampNTZType)
    if not (
        kinds[0] == kinds[1] and isinstance(kinds[0], timed)
        or all(isinstance(k, T.IntegralType) for k in kinds)
    ):
        raise ValueError(f"{start} and {end} must be timestamps of one type, or integers")


def admit_sends(
    sends: DataFrame,
    key: str = "key",
    start: str = "start",
    end: str = "end",
    id: str = "id",
    max_rows: int | None = None,
    max_links: int | None = None,
    forced: str | None = None,
) -> DataFrame:
    """Sends with `admitted`; equal starts are decided in the order of `id`.

    Runs a counting job while the plan is made, and where a key is cut a few more, see `_entries`.

    A send without an end is pending for good. `start` and `id` must not be null, and (key, start, id)
    must be unique. `forced` names a boolean column of sends that are not held back; the end of any send that went
    out, forced or not, frees the key.
    """
    check_times(sends, start, end)
    chunks = measure(sends, key, (start, id), max_rows)
    rows = assign(sends, chunks)
    if forced is not None:
        return _with_forced(sends, rows, chunks, start, end, id, forced)
    if chunks.bounds is not None:
        entries = _entries(rows, chunks, start, end, id, max_rows, max_links)
        rows = chunks.join_chunks(rows, small(entries, chunks))
    groups = chunks.groups(rows)
    ordered = together(rows, *groups).sortWithinPartitions(*groups, start, id)
    schema = T.StructType([*sends.schema.fields, T.StructField("admitted", T.BooleanType())])
    return ordered.mapInArrow(_walker(sends.columns, groups, start, end), schema)


def decide(starts: list[int], ends: list[int], free: int) -> tuple[list[bool], int]:
    """Walk sends in order from the state `free`; returns the verdicts and the state after them."""
    admitted = []
    for start, end in zip(starts, ends):
        admitted.append(start >= free)
        if start >= free:
            free = end
    return admitted, free


def _ticks(starts: pa.ChunkedArray | pa.Array, ends) -> tuple[np.ndarray, np.ndarray]:
    """Times as integers; an end before its start frees the key at the start."""
    starts = starts.cast(pa.int64()).fill_null(NEVER).to_numpy(zero_copy_only=False)
    ends = ends.cast(pa.int64()).fill_null(FOREVER).to_numpy(zero_copy_only=False)
    return starts, np.maximum(starts, ends)


def _walker(columns: list[str], groups: list[str], start: str, end: str):
    """Task that walks rows sorted by group and carries the state over from batch to batch."""

    def entry(batch: pa.RecordBatch, row: int) -> int:
        # Only a key that was cut has chunks, and a chunk without an entry is skipped as a whole.
        if len(groups) == 1 or not batch.column(groups[1])[row].is_valid:
            return NEVER
        entered = batch.column("_enter")[row]
        return entered.as_py() if entered.is_valid else FOREVER

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, free = None, NEVER
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, ends = _ticks(batch.column(start), batch.column(end))
            cuts = {0}
            for name in groups:
                cuts.update(_run_ends(batch.column(name)))
            cuts = sorted(cuts)
            starts, ends, admitted = starts.tolist(), ends.tolist(), []
            for a, b in zip(cuts, cuts[1:]):
                current = tuple(batch.column(name)[a].as_py() for name in groups)
                if current != group:
                    group, free = current, entry(batch, a)
                verdicts, free = decide(starts[a:b], ends[a:b], free)
                admitted += verdicts
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in columns), pa.array(admitted, pa.bool_())],
                names=[*columns, "admitted"],
            )

    return walk


def _run_ends(values: pa.Array) -> list[int]:
    """Where runs of equal neighbours end; nulls are equal."""
    return pc.run_end_encode(values).run_ends.to_pylist()


def chunk_steps(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tabulate one chunk of ordered sends: found free at `upto` or earlier, it is left free at `exit`.

    Steps ascend by `upto`; a time after the last one passes the chunk by.
    """
    n = len(starts)
    # The next send to be admitted after send i, n when there is none in the chunk.
    following = np.maximum(np.searchsorted(starts, ends, side="left"), np.arange(1, n + 1))
    exits = ends.copy()
    # Views hand out plain integers without a list of them.
    after, left = memoryview(following), memoryview(exits)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            left[i] = left[after[i]]
    # Of equal starts the first send decides; of neighbouring equal exits the last step stands for all.
    distinct = np.concatenate([[True], starts[1:] != starts[:-1]])
    upto, exits = starts[distinct], exits[distinct]
    turning = np.concatenate([exits[1:] != exits[:-1], [True]])
    return upto[turning], exits[turning]


def _entries(
    rows: DataFrame,
    chunks: Chunks,
    start: str,
    end: str,
    id: str,
    max_rows: int | None,
    max_links: int | None,
) -> DataFrame:
    """(_key, _number, _enter) for each chunk in which a send is admitted.

    Chunks are tabulated and linked in jobs of their own. No more than `max_links` links of a key are followed in one
    pass; more are followed by doubling, two jobs a round.
    """
    key = chunks.key
    cut = rows.where(F.col(CHUNK).isNotNull()).select(key, CHUNK, start, end, id)
    schema = T.StructType(
        [
            cut.schema[key],
            cut.schema[CHUNK],
            T.StructField("_upto", T.LongType()),
            T.StructField("_exit", T.LongType()),
        ]
    )

    def tabulate(table: pa.Table) -> pa.Table:
        table = table.sort_by([(start, "ascending"), (id, "ascending")])
        upto, exits = chunk_steps(*_ticks(table[start].combine_chunks(), table[end].combine_chunks()))
        place = table.select([key, CHUNK]).take(np.zeros(len(upto), dtype=np.int64))
        return place.append_column("_upto", [upto]).append_column("_exit", [exits])

    # A chunk is bounded by construction, so it may be one group.
    steps = cut.groupBy(key, CHUNK).applyInArrow(tabulate, schema).checkpoint()

    # A chunk is felt at times after the last start of the one before, up to its own last start.
    along = Window.partitionBy(key).orderBy(CHUNK)
    spans = (
        steps.groupBy(key, CHUNK)
        .agg((F.max("_upto") + 1).alias("_to"))
        .select(F.col(key).alias("_key"), CHUNK, F.lag("_to").over(along).alias("_from"), "_to")
    )
    # A node is a time at which a chunk leaves its key free; the start is left by a chunk before all.
    before = steps.groupBy(key).agg(F.lit(-1).alias("_from_chunk"), F.lit(NEVER).alias("_time"))
    left = steps.select(key, F.col(CHUNK).alias("_from_chunk"), F.col("_exit").alias("_time"))
    probes = (
        locate(before.unionByName(left.distinct()), chunks, spans, F.col("_time"), "_felt")
        .where(F.col("_felt").isNotNull())
        .withColumn("_felt", F.greatest(F.col("_felt"), F.col("_from_chunk") + 1))
    )
    # As-of lookup without a range join: steps and probes in one descending order, where the last step
    # seen is the first that reaches the time of the probe.
    both = steps.select(
        key,
        F.col(CHUNK).alias("_felt"),
        F.lit(None).cast("int").alias("_from_chunk"),
        F.col("_upto").alias("_time"),
        "_exit",
    ).unionByName(probes.withColumn("_exit", F.lit(None).cast("bigint")))
    falling = both.select(
        "*",
        (-F.col("_felt")).alias("_by_chunk"),
        (-F.col("_time")).alias("_by_time"),
        F.col("_from_chunk").isNotNull().alias("_probe"),
        F.when(F.col("_from_chunk").isNull(), F.col("_felt")).alias("_step_chunk"),
    )
    most_rows = MAX_LINKS if max_links is None else max_rows
    search = measure(falling, key, ("_by_chunk", "_by_time", "_probe"), most_rows)
    # A probe beyond the last chunk has no step of its own chunk to see.
    looked_up = scan(
        falling, search, {"_next": Fold("last", "_exit"), "_seen": Fold("last", "_step_chunk")}
    )
    links = (
        looked_up.where(F.col("_probe") & (F.col("_seen") == F.col("_felt")))
        .select(key, F.col("_from_chunk").alias("_from"), "_time", "_felt", "_next")
        .checkpoint()
    )
    most = links.groupBy(key).count().agg(F.max("count")).first()[0]
    if most <= (MAX_LINKS if max_links is None else max_links):
        ordered = together(links, key).sortWithinPartitions(key, "_from")
        path = ordered.mapInArrow(_follower(key), links.schema)
    else:
        path = _on_node(chunks, links, _reachable(links, chunks))
    return path.select(
        F.col(key).alias("_key"), F.col("_felt").alias("_number"), F.col("_time").alias("_enter")
    )


def _follower(key: str):
    """Task that follows each key's links from its start; links lead to later chunks, so once is enough."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, node = object(), None
        for batch in batches:
            taken = []
            names = (key, "_from", "_time", "_felt", "_next")
            links = zip(*(batch.column(name).to_pylist() for name in names))
            for i, (current, chunk, time, felt, after) in enumerate(links):
                if current != group:
                    group, node = current, (-1, NEVER)
                if (chunk, time) == node:
                    taken.append(i)
                    node = (felt, after)
            yield batch.take(pa.array(taken, pa.int64()))

    return follow


def _on_node(chunks: Chunks, links: DataFrame, nodes: DataFrame) -> DataFrame:
    same = (
        chunks.same_key(F.col(chunks.key), F.col("_k"))
        & (F.col("_from") == F.col("_f"))
        & (F.col("_time") == F.col("_t"))
    )
    renamed = nodes.select(
        F.col(chunks.key).alias("_k"), F.col("_from").alias("_f"), F.col("_time").alias("_t")
    )
    return links.join(renamed, same, "left_semi")


def _reachable(links: DataFrame, chunks: Chunks) -> DataFrame:
    """Nodes on the path from each key's start, found in logarithmically many rounds of joins.

    After round k the nodes within 2**k links are known and `jumps` spans 2**k links. A link leads to a later
    chunk, so the longest key's chunks bound the rounds.
    """
    key = chunks.key
    jumps = links.select(
        key, "_from", "_time", F.col("_felt").alias("_to"), F.col("_next").alias("_then")
    )
    reached = links.where(F.col("_from") == -1).select(key, "_from", "_time")
    span = 1
    while span <= chunks.longest and not jumps.isEmpty():
        ahead = _on_node(chunks, jumps, reached).select(
            key, F.col("_to").alias("_from"), F.col("_then").alias("_time")
        )
        reached = reached.unionByName(ahead).checkpoint()
        further = jumps.withColumnsRenamed(
            {key: "_k", "_from": "_f", "_time": "_t", "_to": "_to2", "_then": "_then2"}
        )
        same = (
            chunks.same_key(F.col(key), F.col("_k"))
            & (F.col("_to") == F.col("_f"))
            & (F.col("_then") == F.col("_t"))
        )
        jumps = (
            jumps.join(further, same)
            .select(
                key,
                "_from",
                "_time",
                F.col("_to2").alias("_to"),
                F.col("_then2").alias("_then"),
            )
            .checkpoint()
        )
        span *= 2
    return reached


class Pending:
    """What is out for one key: whether a send is held back, and the ends to come."""

    def __init__(self, busy: bool = False, ends: list[int] | None = None):
        # A sorted list is a heap.
        self.busy, self.ends = busy, sorted(ends or [])

    def admits(self, start: int, end: int, forced: bool) -> bool:
        while self.ends and self.ends[0] <= start:
            heappop(self.ends)
            self.busy = False
        if self.busy and not forced:
            return False
        self.busy = True
        if end < FOREVER:
            heappush(self.ends, end)
        return True


STATE = T.StructType([T.StructField("busy", T.BooleanType()), T.StructField("ends", T.ArrayType(T.LongType()))])


def _forced_walker(columns: list[str], groups: list[str], start: str, end: str, forced: str, exits: bool):
    """Task that walks rows sorted by group; one without a start comes first and brings the state `_enter` of its group.
    Gives the rows with their verdict or, with `exits`, one row per group with what it leaves."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = None, Pending()
        left: list[tuple] = []

        def leave() -> pa.RecordBatch:
            names = [*groups, "busy", "ends"]
            kinds = [*kept_types, pa.bool_(), pa.list_(pa.int64())]
            rows = [pa.array(c, k) for c, k in zip(zip(*left), kinds)] if left else [pa.array([], k) for k in kinds]
            left.clear()
            return pa.RecordBatch.from_arrays(rows, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            kept_types = [batch.column(g).type for g in groups]
            starts, ends = _ticks(batch.column(start), batch.column(end))
            keys = zip(*(batch.column(name).to_pylist() for name in groups))
            must = batch.column(forced).fill_null(False).to_pylist()
            sent = batch.column(start).is_valid()
            given = None if pc.all(sent).as_py() else (sent.to_pylist(), batch.column("_enter"))
            admitted = []
            for i, (key, s, e, f) in enumerate(zip(keys, starts.tolist(), ends.tolist(), must)):
                if key != group:
                    if group is not None and exits:
                        left.append((*group, now.busy, sorted(now.ends)))
                    group, now = key, Pending()
                if given is not None and not given[0][i]:
                    now = Pending(**given[1][i].as_py())
                    continue
                admitted.append(now.admits(s, e, f))
            if exits:
                yield leave()
            else:
                kept = batch.filter(sent) if given is not None else batch
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(name) for name in columns), pa.array(admitted, pa.bool_())], [*columns, "admitted"]
                )
        if exits and group is not None:
            left.append((*group, now.busy, sorted(now.ends)))
            yield leave()

    return walk


def _with_forced(
    sends: DataFrame, rows: DataFrame, chunks: Chunks, start: str, end: str, id: str, forced: str
) -> DataFrame:
    groups, enters = [chunks.key], None
    if chunks.bounds is not None:
        width, enters = _left_by_others(rows.where(F.col(CHUNK).isNotNull()), chunks, start, end, id, forced)
        rows, groups = _stretches(rows, width), [chunks.key, STRETCH]
    schema = T.StructType([*sends.schema.fields, T.StructField("admitted", T.BooleanType())])
    walker = _forced_walker(sends.columns, groups, start, end, forced, exits=False)
    return _from_states(rows, groups, enters, start, id).mapInArrow(walker, schema)


def _stretches(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn(STRETCH, F.floor(F.col(CHUNK) / width)).drop(CHUNK)


def _from_states(rows: DataFrame, groups: list[str], enters: DataFrame | None, start: str, id: str) -> DataFrame:
    """Rows in order by group, a row with the state before them in front; `enters` is (_key, _number, _enter)."""
    if enters is not None:
        first = enters.withColumnsRenamed({"_key": groups[0], "_number": groups[1]})
        rows = rows.unionByName(first, allowMissingColumns=True)
    return together(rows, *groups).sortWithinPartitions(*groups, F.col(start).asc_nulls_first(), id)


def _left_by_others(
    rows: DataFrame, chunks: Chunks, start: str, end: str, id: str, forced: str
) -> tuple[int, DataFrame | None]:
    """A width, and (_key, _number, _enter) for each stretch of so many chunks that finds something out when it begins.

    Stretches of one chunk are walked, in a job, and those that find other things than they did are walked again, for
    `ROUNDS` times; then stretches get wider. So there are a few jobs for each factor of `WIDER` in the longest key's
    chunks. What stretches leave is at most what they found and their own sends: some times the rows in all.
    """
    key, groups = chunks.key, [chunks.key, STRETCH]
    # Read once for each walk.
    slim = rows.select(key, CHUNK, start, end, id, forced).checkpoint()
    schema = T.StructType([slim.schema[key], T.StructField(STRETCH, T.LongType()), *STATE])
    along = Window.partitionBy("_key").orderBy("_number")

    def walked(width: int, again: DataFrame | None = None) -> DataFrame:
        """(_key, _number, _exit) of all stretches, or of those of `again`, (_key, _number, _enter), from their states."""
        given, enters = _stretches(slim, width), None
        if again is not None:
            on = chunks.same_key(F.col(key), F.col("_key")) & (F.col(STRETCH) == F.col("_number"))
            given = given.join(again.select("_key", "_number"), on, "left_semi")
            enters = again.where(F.col("_enter").isNotNull())
        ordered = _from_states(given, groups, enters, start, id)
        exits = ordered.mapInArrow(_forced_walker([], groups, start, end, forced, exits=True), schema)
        return exits.select(
            F.col(key).alias("_key"), F.col(STRETCH).alias("_number"), F.struct("busy", "ends").alias("_exit")
        )

    def compared(known: DataFrame) -> DataFrame:
        """With what each stretch should have found, `_found`, and whether it has to be walked again."""
        before = F.lag("_exit").over(along)
        # Nothing out is what a stretch that nobody leaves anything to begins with.
        found = F.when(before["busy"] | (F.size(before["ends"]) > 0), before)
        behind = F.floor(F.lag("_number").over(along) / WIDER) == F.floor(F.col("_number") / WIDER)
        seen = known.select("*", found.alias("_found"), F.coalesce(behind, F.lit(False)).alias("_inner"))
        return seen.withColumn("_stale", F.col("_torn") | ~F.col("_found").eqNullSafe(F.col("_enter")))

    width, none = 1, F.lit(None).cast(STATE)
    known = walked(width).select("*", none.alias("_enter"), F.lit(False).alias("_torn")).checkpoint()
    while True:
        for _ in range(ROUNDS):
            then = compared(known)
            stale = then.where("_stale")
            if stale.isEmpty():
                return width, known.where(F.col("_enter").isNotNull()).select("_key", "_number", "_enter")
            again = stale.select("_key", "_number", F.col("_found").alias("_enter"))
            anew = walked(width, again).withColumnsRenamed({"_key": "_k", "_number": "_n"})
            same = chunks.same_key(F.col("_key"), F.col("_k")) & (F.col("_number") == F.col("_n"))
            fresh = again.join(anew, same).select("_key", "_number", "_exit", "_enter", F.lit(False).alias("_torn"))
            kept = then.where(~F.col("_stale")).select(*fresh.columns)
            known = kept.unionByName(fresh).checkpoint()
        width *= WIDER
        if width >= chunks.longest:
            return width, None
        # A wider stretch is right inside where none of its own but the first finds other things than it did.
        known = (
            compared(known)
            .groupBy("_key", F.floor(F.col("_number") / WIDER).alias("_wide"))
            .agg(
                F.max_by("_exit", "_number").alias("_exit"),
                F.min_by("_enter", "_number").alias("_enter"),
                F.bool_or(F.col("_torn") | F.col("_stale") & F.col("_inner")).alias("_torn"),
            )
            .withColumnRenamed("_wide", "_number")
            .checkpoint()
        )
