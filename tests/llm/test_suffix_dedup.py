"""Removed bytes against every string of every document, and the suffix array against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

from colloquy.llm import catalog, suffix_dedup as d
from colloquy.llm.suffix_array import permuted_common_prefixes, suffix_array


def plain(rows, length=50):
    """Per row the maximal removed runs."""
    first = {}
    for id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1) if id is not None else ():
            key = data[i : i + length]
            first[key] = min(first.get(key, id), id)
    out = []
    for id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, np.int8)
        for i in range(len(data) - length + 1) if id is not None else ():
            if first[data[i : i + length]] < id:
                gone[i + 1 : i + 1 + length] = 1
        edges = np.diff(gone)
        out.append(list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())))
    return out


def cases():
    dice = random.Random(8)
    word = lambda: "".join(dice.choice(["th", "e", "an", "é", "on", "ß"]) for _ in range(dice.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (4, 8, 9, 10, 12, 20, 60)] + ["a" * 49, "b" * 50, "ab" * 40, "x" * 300, "\0" * 60]
    rows = []
    for i in range(160):
        parts = [text(dice.randrange(0, 30))]
        for _ in range(dice.randrange(4)):
            p = dice.choice(passages)
            cut = dice.randrange(len(p))
            parts.append(dice.choice([p, p, p[cut:], p[: cut + 40]]) + text(dice.randrange(12)))
        rows.append((1000 - 3 * i, dice.choice(["", " "]).join(parts)))
    rows += [(5000 + i, rows[i][1]) for i in range(40)]  # copies
    rows += [(6000 + i, rows[i][1][:200] + "#" + rows[i][1][200:]) for i in range(40)]  # near copies
    rows += [(7000 + i, text(3) + " " + passages[6] + " " + text(3)) for i in range(60)]  # one passage, edges differ
    rows += [(None, rows[0][1]), (None, rows[0][1]), (9000, None), (9001, ""), (9002, "z" * 49), rows[3], rows[3]]
    rows += [(-4, passages[6]), (-4, "other " + passages[5] + passages[6]), (8000, "q" * 5000), (8001, "q" * 3000 + "r")]
    return rows


@pytest.mark.parametrize(
    "settings",
    [
        d.Settings(),
        d.Settings(chunk=700, shard=900),
        d.Settings(in_batch=3),
        d.Settings(in_all=3, shard=500),
        d.Settings(in_batch=1, in_all=1),
        d.Settings(gram=12),
    ],
)
def test_equal_plain(spark, settings):
    rows = cases()
    docs = spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], "doc_id LONG, text STRING, kept STRING, mark INT").repartition(3)
    got = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], [(x["start"], x["end"]) for x in r["spans"]], bytes(r["kept"]))
        for r in d.remove_repeats(docs, settings).collect()
    )
    want = []
    for (id, text), spans in zip(rows, plain(rows)):
        data = (text or "").encode()
        keep = np.ones(len(data), bool)
        for a, b in spans:
            keep[a:b] = False
        left = bytes(np.frombuffer(data, np.uint8)[keep]) if data else b""
        want.append((id is None, id or 0, len(data), spans, left))
    assert got == sorted(want)
    assert sum(len(w[3]) for w in want) > 100


def test_query_equals_plain(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in catalog.QUERIES["op9_suffix_dedup"](spark, folder).collect()}
    want = {}
    for (id, text), spans in zip(rows, plain(rows)):
        data = bytearray(text.encode())
        n = len(data)
        for a, b in reversed(spans):
            del data[a:b]
        want[id] = (n, n - len(data), len(spans), hashlib.sha256(data).hexdigest())
    assert got == want
    assert sum(w[1] for w in want.values()) > 1000


def test_empty_table(no_documents):
    assert d.remove_repeats(no_documents).count() == 0


def test_every_string_has_its_anchor():
    s = d.Settings()
    dice = np.random.default_rng(1)
    data = dice.integers(97, 101, 5000).astype(np.uint8)
    whole = d._of_texts(data, np.array([0]), np.array([5000]), np.array([3]), s)
    assert np.array_equal(whole[1], d.anchors(data, np.array([0]), np.array([5000]), s)[0])
    # Every string has its anchor inside.
    for i in range(len(data) - 49):
        assert ((whole[1] >= i) & (whole[1] <= i + 30)).any()


def test_suffix_array_equals_plain_sorting():
    dice = random.Random(6)
    for _ in range(1500):
        n, most = dice.randrange(1, 70), dice.choice([1, 2, 3, 200])
        s = np.array([dice.randrange(1, most + 1) for _ in range(n - 1)] + [0], np.uint16)
        assert suffix_array(s, 100).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_common_prefixes():
    dice = np.random.default_rng(2)
    data = dice.integers(0, 2, 4000).astype(np.uint8) * 255
    data[2000:2100] = data[100:200]
    a, b = dice.integers(0, 3900, 3000), dice.integers(0, 3900, 3000)
    a[:40], b[:40] = 100 + np.arange(40), 2000 + np.arange(40)
    got = permuted_common_prefixes(data, a, b, 50)
    for x, y, n in zip(a, b, got):
        equal = data[x : x + 50] == data[y : y + 50]
        assert n == (50 if equal.all() else int(equal.argmin()))
