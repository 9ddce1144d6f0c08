"""Findings against plain edit distances over whole texts, at every length, place and number of edits."""

import random

import numpy as np
import pytest

from colloquy.llm import catalog, decontaminate as d

SETTINGS = d.Settings()


def least_edits(pattern, text):
    """Least edits that turn the pattern into some part of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


def plain(text, items, s=SETTINGS):
    """(item, segments found, least edits of them) by trying every segment on the whole text."""
    codes = d.normal(text or "")[0].tolist()
    found = []
    for i, (_, item) in enumerate(items):
        costs = []
        for part in d.segments(d.trimmed(d.normal(item or "")[0]), s):
            allowed = min(int(s.rate * len(part)), (len(part) - s.q) // s.q)
            cost = least_edits(part.tolist(), codes)
            if cost <= allowed:
                costs.append(cost)
        if costs:
            found.append((i, len(costs), sum(costs)))
    return found


def words(dice, n):
    return " ".join(dice.choice(["the", "of", "thndwh", "éin", "Über", "re"]) + dice.choice(["", "a", "st.", ","]) for _ in range(n))


def edited(dice, text, n):
    out = list(text)
    for _ in range(n):
        at = dice.randrange(len(out))
        kind = dice.randrange(3)
        out[at : at + 1] = [] if kind == 0 else ["#"] if kind == 1 else [out[at], "x"]
    return "".join(out)


def cases():
    dice = random.Random(4)
    items = [(i, words(dice, n)) for i, n in enumerate([3, 6, 10, 14, 20, 30, 45, 70])]
    items += [(90, items[4][1]), (91, ""), (92, "short"), (93, "   "), (94, "exactly8")]
    texts = ["", "   ", words(dice, 300)]
    for _, item in items:
        for n in (0, 2, 5, 8, 12):
            body = edited(dice, item, n) if item.strip() else item
            texts.append(words(dice, dice.randrange(12)) + " " + body.upper().replace(" ", "  \n") + " " + words(dice, dice.randrange(12)))
        texts.append(item)
        texts.append(item[: len(item) * 2 // 3])
    return items, texts


def test_search_equals_plain_edit_distances():
    items, texts = cases()
    index = d.build(items, SETTINGS)
    got = d.leaks_of(texts, index, SETTINGS)
    hits = 0
    for text, own in zip(texts, got):
        want = plain(text, items)
        assert [(x.item, x.segments, x.edits) for x in own] == want, text
        hits += len(want)
        for x in own:
            assert 0 <= x.start < x.end <= len(text)
    assert hits > 40


def test_spans_are_the_passage():
    items = [(5, "One passage that the benchmark has, and no other text should ever have it in there.")]
    text = "é " * 70_000 + "x.  ONE passage that\n\nthe benchmark has, and no other text should ever have it in there. y"
    (leak,) = d.leaks_of([text], d.build(items, SETTINGS), SETTINGS)[0]
    assert text[leak.start : leak.end] == "ONE passage that\n\nthe benchmark has, and no other text should ever have it in there."
    assert leak.edits == 0


def test_alignment_equals_the_recurrence():
    dice = np.random.default_rng(3)
    for _ in range(200):
        m, width = int(dice.integers(1, 12)), int(dice.integers(1, 9))
        pattern, text = dice.integers(1, 4, (1, m)), dice.integers(1, 4, (1, m + width))
        cost, end = d.align(pattern, text, width)
        # Plain recurrence over the same band.
        inf = 10**6
        row = {k: 0 for k in range(width)}
        for i in range(m):
            new = {}
            for k in range(width):
                new[k] = min(row[k] + int(pattern[0, i] != text[0, i + k]), row.get(k + 1, inf) + 1, new.get(k - 1, inf) + 1)
            row = new
        assert cost[0] == min(row.values())
        assert row[int(end[0]) - m] == cost[0]


def test_tables(spark, awkward, no_documents):
    items, texts = cases()
    docs = awkward(texts)
    bench = spark.createDataFrame([(i, t, "x") for i, t in [*items, (None, items[5][1]), (99, None)]], "item_id LONG, text STRING, doc_id STRING")
    small = SETTINGS._replace(block=300, chunk=1000)
    want = {(i, items[k][0]) for i, t in enumerate(texts) for k, *_ in plain(t, items)}
    for s in (SETTINGS, small):
        got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, bench, s).collect()}
        assert {g for g in got if None not in g} == want
        kept = d.drop_leaks(docs, bench, s)
        assert kept.columns == docs.columns
        clean = {i for i in range(len(texts) + 3)} - {w[0] for w in want}
        assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == clean
    assert d.find_leaks(no_documents, bench).count() == 0
    assert d.find_leaks(docs, bench.limit(0)).count() == 0
    assert d.drop_leaks(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_finds_the_passages_of_the_test_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    whole = {(x["doc_id"], i["item_id"]) for x in docs for i in items if i["text"] in x["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in catalog.QUERIES["op10_decontamination"](spark, folder).collect()}
    assert whole and whole <= got
    other = {i["item_id"] for i in items}
    part = {(x["doc_id"], i["item_id"]) for x in docs for i in items if i["text"][10:50] in x["text"]}
    assert got <= part and {g[1] for g in got} <= other
