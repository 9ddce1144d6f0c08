"""The mix against a walk over documents in the order of their hashes."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from colloquy.llm import mixing


def plain_targets(sizes, weights):
    """{source: target}, shared in rounds."""
    total, target = sum(sizes.values()), {}
    open_, rest = set(sizes), Fraction(total)
    while open_:
        shares = sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / shares > 3 * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / shares for s in open_}
        target |= {s: Fraction(3 * sizes[s]) for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def plain_mix(rows, near=1000):
    """Sorted (id, size, source_size, target, taken)."""
    docs = []
    for id, text, source in rows:
        text = text or ""
        name = f"{'none' if id is None else id}:{text}"
        h = int(hashlib.md5(name.encode()).hexdigest()[:15], 16)
        docs.append((id, source, len(re.findall(r"[^\x20\x09-\x0D]+", text)), h))
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[1]] += d[2]
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {s: float(t) for s, t in plain_targets(sizes, weights).items()}
    out, sums = [], defaultdict(int)
    for s in names:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        left = most = int(target[s] - whole * sizes[s])
        groups = defaultdict(list)
        for d in docs:
            if d[1] == s:
                groups[d[3]].append(d[2])
        once, done = set(), left * near <= target[s]
        for h in sorted(groups):
            if done or not 0 < groups[h][0] <= most:
                continue
            if sum(groups[h]) <= left:
                once.add(h)
                left -= sum(groups[h])
            else:
                most, done = left, left * near <= target[s]
        if left * near > target[s]:
            more = [(abs(sum(g) - left), h) for h, g in groups.items() if h not in once and 0 < sum(g) < 2 * left]
            once |= {min(more)[1]} if more else set()
        for d in docs:
            if d[1] == s:
                taken = d[2] * (whole + (d[3] in once and d[2] > 0))
                out.append((d[0], d[2], sizes[s], target[s], taken))
                sums[s] += taken
    return sorted(out, key=str), {s: (sums[s], target[s]) for s in names}


def made(seed, n=600):
    dice = random.Random(seed)
    names = ["web", "a", "Z", "é", "\U0001f600", "￿", "zero", "tiny", "", None]
    rows = []
    for i in range(n):
        source = "web" if i % 3 == 0 else dice.choice(names[1:-1] if i % 7 else names)
        n_words = 0 if source == "zero" else dice.choice([0, 1, 3, 10, 40, 200])
        rows.append((i, " ".join("w" * dice.randrange(1, 4) for _ in range(n_words)), source))
    rows += [(None, "a b c", "a")] * 5 + [(7, None, "a"), (8, "\x0b ", "Z"), (9, "a\x1cb", "Z"), (10, "x", "tiny2")]
    return rows


SCHEMA = "doc_id LONG, text STRING, source STRING, size STRING, hash INT"


def shown(df):
    rows = df.collect()
    return sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["size"] * r["repeats"]) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_plain_walk(spark, monkeypatch, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want, _ = plain_mix(rows)
    got = shown(mixing.mix(docs))
    assert [(a, b, c, e) for a, b, c, _, e in got] == [(a, b, c, e) for a, b, c, _, e in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert {r[4] // r[1] for r in want if r[1]} >= {0, 1, 2, 3}
    # Buckets that are split three times, and sources that are too many to broadcast.
    monkeypatch.setattr(mixing, "SPLIT", 3)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 2)
    assert shown(mixing.mix(docs.repartition(7))) == got


def test_sources_come_near_their_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 400), f"s{i * i % 11}") for i in range(3000)]
    _, sums = plain_mix(rows)
    assert all(abs(a - t) <= max(t / 1000, 1) for a, t in sums.values())


def test_given_weights_and_targets(spark):
    docs = spark.createDataFrame([(i, "a b c d e", "x" if i % 4 else "y", "", 0) for i in range(400)], SCHEMA)
    weights = spark.createDataFrame([("x", 1.0), ("y", 9.0)], "source STRING, weight DOUBLE")
    rows = mixing.mix(docs, weights=weights).groupBy("target").sum("repeats").collect()
    # y would get 1,800 of 2,000 words and has 500.
    assert sorted((r[0], r[1]) for r in rows) == [(500.0, 100), (1500.0, 300)]


def test_no_documents_and_no_words(spark, no_documents):
    assert mixing.mix(no_documents).count() == 0
    blank = spark.createDataFrame([(1, None, "a", "", 0), (2, " ", None, "", 0)], SCHEMA)
    assert shown(mixing.mix(blank)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_ranks_follow_code_points(spark):
    names = ["b", "a", "B", "é", "￿", "\U0001f600", "", None, "aa"]
    sources = spark.createDataFrame([(n, 1) for n in names], "source STRING, source_size LONG").repartition(5)
    got = {r["source"]: r["weight"] for r in mixing.weights_in_turn(sources).collect()}
    order = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    assert got == {s: i % 3 + 1 for i, s in enumerate(order)}


def test_words_times_weight_beyond_an_int(spark):
    # 1.2 billion words are an int, three times as many are not.
    rows = [(i, "abcd"[i % 4], 10_000_000 + i, i * 7919 % 120 << 53) for i in range(120)]
    sizes = spark.createDataFrame(rows, "id LONG, source STRING, size LONG, hash LONG")
    own = {s: sum(r[2] for r in rows if r[1] == s) for s in "abcd"}
    assert sum(own.values()) < 2**31 < 3 * sum(own.values())
    weighted = mixing.weights_in_turn(mixing.sources_of(sizes))
    weights = {r["source"]: r["weight"] for r in weighted.collect()}
    wanted = mixing.targets(weighted)
    want = plain_targets(own, weights)
    assert {r["source"]: r["target"] for r in wanted.collect()} == pytest.approx({s: float(t) for s, t in want.items()})
    got = mixing.taken(sizes, mixing.thresholds(sizes, wanted)).collect()
    assert len(got) == len(rows)
    taken = {s: sum(r["size"] * r["repeats"] for r in got if r["source"] == s) for s in own}
    # The document that was added last brings a source within half a document.
    assert all(abs(taken[s] - want[s]) <= 5_000_120 for s in own)
