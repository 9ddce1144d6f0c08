"""Conversations as training text: turn order checked, segments marked for the loss.

A template declares how a turn opens and closes, which roles are learned and which role may follow which. A
finite-state machine walks the roles of a conversation in order; every turn is written, and one that the
machine does not allow is marked. Control strings inside a text cannot be taken for those of the template: a
backslash is put between their first two characters, and taken out again when the text is read back.

Defined results: a null role or text is empty; rows of equal (conversation, turn) are ordered by role, then text;
rows without a conversation id form one conversation; an empty table gives an empty result; columns other
than the four that are read are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.operators.chunks import CHUNK, Chunks, assign, measure, small, together

START = "start"


class Template(NamedTuple):
    """`moves` maps a state to the state that each allowed role leads to; a role that is not allowed leaves the
    state as it is. A conversation may end in `final` states."""

    opening: str = "<|im_start|>"
    named: str = "\n"
    closing: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    moves: Mapping[str, Mapping[str, str]] = {
        START: {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    }
    final: tuple[str, ...] = ("answered",)


CHATML = Template()


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<" in text else text


def escape_name(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_name(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


FORMATTED = "conv_id BIGINT, turn BIGINT, allowed BOOLEAN, state STRING, segments ARRAY<STRUCT<text: STRING, loss: BOOLEAN>>"
# Of a conversation that is cut: its chunk, and the place of the turn in it.
PLACED = f"{FORMATTED}, chunk INT, place BIGINT"
ORDER = ("known", "at", "role", "text")


def format_conversations(turns: DataFrame, template: Template = CHATML, max_rows: int | None = None) -> DataFrame:
    """One row per turn in reading order: (conv_id, turn, allowed, state, segments).

    `segments` are the texts to be joined, each with its loss flag. Rows of a conversation stand together in one
    partition, in order; they are streamed, so a task holds a batch of turns and one state. A conversation of more
    than `max_rows` turns is cut into chunks that are formatted side by side: what a chunk does to every state of the machine
    is found first, so that each begins with its true state. Then rows have (chunk, place) as well.
    """
    named = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
    )
    chunks = measure(named, "conv_id", ORDER, max_rows)
    if chunks.bounds is None:
        ordered = named.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
        return ordered.mapInArrow(_formatter(template, False), FORMATTED)
    rows = assign(named, chunks)
    entered = chunks.join_chunks(rows, small(_entry_states(rows, chunks, template), chunks))
    groups = chunks.groups(rows)
    ordered = together(entered, *groups).sortWithinPartitions(*groups, *ORDER)
    return ordered.mapInArrow(_formatter(template, True), PLACED)


def _formatter(template: Template, cut: bool):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = START
        state, place = START, 0
        for batch in batches:
            out: dict[str, list] = {"allowed": [], "state": [], "segments": [], "place": []}
            ids = batch.column("conv_id").to_pylist()
            chunk = batch.column(CHUNK).to_pylist() if cut else [None] * len(ids)
            enters = batch.column("_enter").to_pylist() if cut else chunk
            texts = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())
            for group, enter, (role, text) in zip(zip(ids, chunk), enters, texts):
                if group != last:
                    last, state, place = group, enter or START, 0
                moved = template.moves.get(state, {}).get(role)
                state = moved or state
                out["allowed"].append(moved is not None)
                out["state"].append(state)
                out["place"].append(place)
                place += 1
                head = template.opening + escape_name(role) + template.named
                out["segments"].append(
                    [
                        {"text": head, "loss": False},
                        {"text": escape(text), "loss": role in template.learned},
                        {"text": template.closing, "loss": False},
                    ]
                )
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            columns = [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.array(out["allowed"], pa.bool_()),
                pa.array(out["state"], pa.string()),
                pa.array(out["segments"], kind),
            ]
            if cut:
                columns += [pa.array(chunk, pa.int32()), pa.array(out["place"], pa.int64())]
            names = ["conv_id", "turn", "allowed", "state", "segments", "chunk", "place"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return walk


def _entry_states(rows: DataFrame, chunks: Chunks, template: Template) -> DataFrame:
    """(_key, _number, _enter): the state in which the machine comes to each chunk."""
    states = sorted({START, *template.moves, *(s for m in template.moves.values() for s in m.values())})
    groups = chunks.groups(rows)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk the state after it for each state before it."""
        now, after, done = None, states, []
        for batch in batches:
            for group, role in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if group != now:
                    if now is not None:
                        done.append((*now, after))
                    now, after = group, states
                after = [template.moves.get(s, {}).get(role) or s for s in after]
            if done:
                yield rows_of(done)
                done = []
        if now is not None:
            yield rows_of([(*now, after)])

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["key", "number", "after"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, START
        for batch in batches:
            enters = []
            for key, after in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if (key,) != now:
                    now, state = (key,), START
                enters.append(state)
                state = after[states.index(state)]
            columns = [batch.column(0), batch.column(1), pa.array(enters, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_number", "_enter"])

    cut = rows.where(F.col(CHUNK).isNotNull()).select("conv_id", CHUNK, "role", "known", "at", "text")
    sorted_ = cut.repartition(*groups).sortWithinPartitions(*groups, *ORDER)
    found = sorted_.mapInArrow(effects, "key BIGINT, number INT, after ARRAY<STRING>")
    # A row per chunk.
    along = found.repartition("key").sortWithinPartitions("key", "number")
    return along.mapInArrow(follow, "_key BIGINT, _number INT, _enter STRING")


DIGESTS = (
    "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, "
    "formatted_chars BIGINT, valid BOOLEAN"
)


class Reader:
    """Finds the turns in the text of a conversation, which comes piece by piece, by its control strings alone."""

    def __init__(self, template: Template):
        self.template, self.text = template, ""
        self.open, self.close = template.opening.strip(), template.closing.strip()
        self.control = re.compile(f"{re.escape(self.open)}|{re.escape(self.close)}")

    def read(self, piece: str, last: bool = False) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that are whole by now, still escaped; with `last` what is left is a turn as well."""
        self.text += piece
        while True:
            begin = self.text.find(self.open)
            if begin < 0:
                return
            inside = begin + len(self.open)
            end = self.control.search(self.text, inside)
            if end is None or end[0] == self.close and not last and len(self.text) < end.start() + len(self.template.closing):
                if last:
                    yield self._turn(self.text[inside:])
                    self.text = ""
                return
            yield self._turn(self.text[inside : end.start()])
            whole = self.text.startswith(self.template.closing, end.start())
            after = len(self.template.closing) if whole else 0 if end[0] == self.open else len(self.close)
            self.text = self.text[end.start() + after :]

    def _turn(self, text: str) -> tuple[str, str]:
        role, _, said = text.partition(self.template.named)
        return role, said


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation, made from the formatted text alone: segments are joined to one text, the turns
    are found in it by its control strings, and digests are made of them and of all text under the loss mask.

    Takes what `format_conversations` returns, as it comes. A conversation is read by one task, as its digests are of all
    of it in order; it holds a turn at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        names = [f.split()[0] for f in DIGESTS.split(", ")]
        done: list[dict] = []

        def add(turns: Iterator[tuple[str, str]]) -> None:
            for role, text in turns:
                now["turns"] += 1
                now["all"].update(f"{unescape_name(role)}\n{unescape(text)}\n".encode())

        def close() -> None:
            if now is not None:
                add(now["reader"].read("", last=True))
                done.append(
                    {
                        "conv_id": now["id"],
                        "n_turns": now["turns"],
                        "turns_sha256": now["all"].hexdigest(),
                        "loss_chars": now["loss_chars"],
                        "loss_sha256": now["loss"].hexdigest(),
                        "formatted_chars": now["chars"],
                        "valid": now["valid"] and now["state"] in template.final,
                    }
                )

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names
            )

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["id"]:
                    close()
                    now = {"id": row["conv_id"], "turns": 0, "chars": 0, "loss_chars": 0, "valid": True, "state": ""}
                    now |= {"all": hashlib.sha256(), "loss": hashlib.sha256(), "reader": Reader(template)}
                now["valid"] &= row["allowed"]
                now["state"] = row["state"]
                for segment in row["segments"]:
                    now["chars"] += len(segment["text"])
                    add(now["reader"].read(segment["text"]))
                    if segment["loss"]:
                        learned = unescape(segment["text"])
                        now["loss_chars"] += len(learned)
                        now["loss"].update(learned.encode())
            if done:
                yield batch_of(done)
                done = []
        close()
        if done:
            yield batch_of(done)

    if "chunk" in formatted.columns:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place")
    return formatted.mapInArrow(digest, DIGESTS)
