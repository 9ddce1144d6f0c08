"""Periodic runs against a walk along every period."""

import random
import re

import numpy as np
import pytest

from colloquy.llm import periodic_runs as p


def plain_runs(words):
    """(start, end, period) of all runs."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def made(dice):
    kinds, n = dice.choice([1, 2, 3, 5, 50]), dice.choice([0, 1, 5, 12, 13, 30, 80, 200])
    words = [dice.randrange(kinds) for _ in range(n)]
    if n and dice.random() < 0.6:
        a = dice.randrange(n)
        period = 1 + (n - a) // (3 + dice.randrange(8))
        words = [words[i if i < a else a + (i - a) % period] for i in range(n)]
    if dice.random() < 0.3:
        again = words[: dice.randrange(40)]
        words = words + again + again + [99] + again
    return words


@pytest.mark.parametrize("pairs", [1, 1 << 21])
def test_runs_of_small_texts(monkeypatch, pairs):
    monkeypatch.setattr(p, "PAIRS", pairs)
    dice, total = random.Random(pairs), 0
    for _ in range(150):
        texts = [made(dice) for _ in range(dice.randrange(1, 6))]
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        got = p.runs_of(np.array([w for t in texts for w in t], np.int64), ends - sizes, ends)
        want = [(s + o, e + o, q) for t, o in zip(texts, (ends - sizes).tolist()) for s, e, q in plain_runs(t)]
        assert list(zip(*(c.tolist() for c in got))) == want
        total += len(want)
    assert total > 200


def test_weak_fingerprints_are_noticed(monkeypatch):
    monkeypatch.setattr(p, "PRIMES", (10007,))
    real, seeds = p.Extensions, []

    class Weak(real):
        def __init__(self, words, seed):
            seeds.append(seed)
            super().__init__(words if seed else words * 0, seed)

    monkeypatch.setattr(p, "Extensions", Weak)
    words = [i % 6 for i in range(24)] + [i % 3 for i in range(24)]
    got = p.runs_of(np.array(words, np.int64), np.array([0]), np.array([48]))
    assert list(zip(*(c.tolist() for c in got))) == plain_runs(words)
    assert len(seeds) > 1


def test_rules_spell_their_places():
    dice = random.Random(3)
    words = np.array([dice.randrange(4) for _ in range(600)] * 2, np.int64)
    g = p.Grammar(words, np.array([0, 500]), np.array([500, 1200]))
    assert len(g.left) > 50
    for r in range(len(g.left)):
        places = g.places[g.from_[r] : g.from_[r + 1]]
        assert len(places) > 1 and 0 < g.left[r] < g.size[r]
        assert len({words[x : x + g.size[r]].tobytes() for x in places}) == 1
        assert len({x < 500 for x in places} & {x + g.size[r] <= 500 for x in places}) >= 1


@pytest.mark.parametrize("n", [200_000])
def test_long_texts(n):
    # One word again and again, a period of three, and the Fibonacci word with its many runs of all lengths.
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    for words, many in ((np.zeros(n, np.int64), False), (np.arange(n) % 3, False), (np.array(b[:n]), True)):
        got = p.runs_of(words, np.array([0]), np.array([n]))
        assert (len(got[0]) > n / 10) if many else [c.tolist() for c in got] == [[0], [n], [1 if not words.any() else 3]]


def test_operator_on_awkward_rows(spark, awkward, no_documents):
    texts = [
        "a b " * 10 + "c",
        "x\x1cy\xa0z\x85 " * 8,
        " ".join(f"w{i}" for i in range(40)) * 2,
        "é 漢 " * 9 + "\n\x0b\x0c\r\t ",
        ("one two three four five six seven eight nine ten eleven twelve thirteen " * 3)[:-10],
        "long " * 30_000,
    ]
    docs = awkward(texts)
    given = {(r["doc_id"]): r["text"] for r in docs.collect()}
    rows = p.find_runs(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", given[r["doc_id"]] or "")
        assert r["n_words"] == len(words)
        want = [(0, len(words), 1)] if len(words) == 30_000 else [(s, e - s, q) for s, e, q in plain_runs(words)]
        assert [tuple(x) for x in r["runs"]] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert p.find_runs(no_documents).count() == 0


def test_packs_do_not_change_results(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('a', id % 7, ' b c '), 3 + id % 5) AS text").coalesce(1)
    want = sorted(p.find_runs(docs).collect())
    monkeypatch.setattr(p, "PACK", 500)
    assert sorted(p.find_runs(docs).collect()) == want
    assert any(r["runs"] for r in want)
