"""Long runs of one character: one gram with few surroundings in very many places."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from colloquy.llm import suffix_dedup as d
from test_suffix_dedup import plain


def rows():
    return [
        (1, "start of the first text " + "-" * 30_000 + " and its end"),
        (2, "another text " + "-" * 70 + " with a short run, which ends otherwise"),
        (3, "short line\n" * 2500 + "end"),
        (4, "before it a short line\n" + "short line\n" * 8 + "after"),
        (5, "x" * 10 + "-" * 20_000 + "y"),
    ]


def test_no_shard_gets_all_places_of_a_run():
    s = d.Settings(in_all=1000)
    ids, texts = zip(*rows())
    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([0] * len(ids), pa.int32()), pa.array(texts)], ["id", "mark", "t"]
    )
    # Cells of two batches in one bucket, as a task gets them.
    cells = [c for part in (batch.slice(0, 2), batch.slice(2)) for c in d._find(s, 1)(iter([part]))]
    fates = pa.Table.from_batches(list(d._resolve(s)(iter(cells)))).combine_chunks()
    fates = fates.group_by(["id", "mark"]).aggregate([("kind", "list"), ("data", "list")]).to_pylist()
    given = [[{"kind": k, "data": x} for k, x in zip(f["kind_list"], f["data_list"])] for f in fates]
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("data", pa.binary())]))
    text = dict(zip(ids, texts))
    cut = pa.RecordBatch.from_arrays(
        [
            pa.array([f["id"] for f in fates], pa.int64()),
            pa.array([0] * len(fates), pa.int32()),
            pa.array([text[f["id"]] for f in fates]),
            pa.array(given, kind),
        ],
        ["id", "mark", "t", "fates"],
    )
    pieces = pa.Table.from_batches(list(d._cut(s)(iter([cut]))))
    opened = pieces.filter(pa.compute.equal(pieces.column("kind"), d.OPEN)).column("g").to_numpy()
    most = np.unique(opened, return_counts=True)[1].max() if len(opened) else 0
    assert most <= s.in_all
    assert pa.compute.sum(pa.compute.equal(pieces.column("kind"), d.STRINGS)).as_py() > 30_000


def test_runs_equal_plain(spark):
    docs = spark.createDataFrame(rows(), "doc_id LONG, text STRING").repartition(2)
    want = dict(zip([r[0] for r in rows()], plain(rows())))
    for settings in (d.Settings(), d.Settings(in_all=1000)):
        got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"]] for r in d.remove_repeats(docs, settings).collect()}
        assert got == want
    assert sum(map(len, want.values())) >= 3
