"""Fingerprints and components against plain Python."""

import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from colloquy.llm import simhash
from colloquy.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def texts():
    dice = random.Random(3)
    made = ["", " \n", "One", "one TWO", "one two", "É x é y z", "\x0b a\x0cb\tc\x1cd e", "a b c " * 500]
    for _ in range(30):
        base = [dice.choice(["the", "of", "Thndwh", "ère", "ü"]) + str(dice.randrange(900)) for _ in range(400)]
        made.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            for _ in range(dice.randrange(3)):
                near[dice.randrange(len(near))] = "x"
            made.append(" ".join(near))
    return made


def test_equal_plain(awkward):
    docs = awkward(texts())
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    label = plain_components(pairs, range(len(rows)))
    smallest = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            smallest[label[i]] = min(smallest.get(label[i], r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"] is None, r["doc_id"]), p, smallest.get(label[i])) for i, (r, p) in enumerate(zip(rows, prints)))
    got = sorted(
        ((r["doc_id"] is None, r["doc_id"]), r["fingerprint"] % 2**64, r["component_id"])
        for r in simhash.near_duplicates(docs).collect()
    )
    assert got == want
    assert 30 < len({w[2] for w in want}) < len(rows) - 30


def near_prints(n, around, flips, seed):
    dice = random.Random(seed)
    centres = [dice.getrandbits(64) for _ in range(around)]
    out = set(centres)
    while len(out) < n:
        x = dice.choice(centres)
        for _ in range(dice.randrange(flips + 1)):
            x ^= 1 << dice.randrange(64)
        out.add(x)
    return sorted(out)


def test_links_lose_nothing_whatever_the_tile(spark):
    for n, around, tile, count in ((1500, 200, 4096, None), (1200, 2, 100, None), (1200, 2, 4096, 2), (800, 3, 7, None)):
        prints = near_prints(n, around, 4, n + tile)
        values = np.array(prints, np.uint64)
        near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2)
        want = plain_components([(prints[i], prints[j]) for i, j in near if i < j], prints)
        signed = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fingerprint LONG")
        edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.near_links(signed, tile=tile, count=count).collect()]
        assert all((a ^ b) for a, b in edges)
        assert plain_components(edges, prints) == want


def test_masks_cover_every_pair_within_the_radius():
    dice = random.Random(1)
    for radius, count in ((0, 10), (1, 10**4), (2, 10**3), (2, 10**6), (2, 10**10), (3, 10**5)):
        chosen = simhash.masks(radius, count)
        for _ in range(300):
            x = dice.getrandbits(64)
            y = x
            for bit in dice.sample(range(64), radius):
                y ^= 1 << bit
            assert any((x & m) == (y & m) for m in (c % 2**64 for c in chosen))


def test_components(spark):
    dice = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(500)] + [(5, 5), (7, 6)]
    pairs += [(dice.randrange(2000, 2600), dice.randrange(2000, 2600)) for _ in range(300)] + [(None, 3)]
    edges = spark.createDataFrame(pairs, "a LONG, b LONG")
    clean = [(a, b) for a, b in pairs if a is not None]
    want = plain_components(clean, {x for p in clean for x in p})
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(edges.limit(0)).count() == 0


def test_empty_table(no_documents):
    assert simhash.near_duplicates(no_documents).count() == 0
