"""Spanning edges against a plain union of ends."""

import random

import numpy as np
import pytest

from colloquy.llm import components as c
from test_simhash import plain_components


def made(seed):
    dice = random.Random(seed)
    pairs = [(dice.randrange(400), dice.randrange(400)) for _ in range(300)]
    # A long path, and a star.
    pairs += [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(50)]
    dice.shuffle(pairs)
    return [(x * 7919 % 100_003, y * 7919 % 100_003) for x, y in pairs]


@pytest.mark.parametrize("seed", [1, 2])
def test_spanning_edges_keep_components(spark, monkeypatch, seed):
    pairs = made(seed)
    nodes = sorted({x for p in pairs for x in p})
    want = plain_components(pairs, nodes)
    us, vs = c.spanning(*(np.array(x) for x in zip(*pairs)))
    assert dict(zip(us.tolist(), vs.tolist())) == {n: r for n, r in want.items() if n != r}
    monkeypatch.setattr(c, "EDGES", 20)
    edges = spark.createDataFrame([*pairs, *pairs, (3, 3), (None, 4)], "a BIGINT, b BIGINT").repartition(3)
    fewer = c.forest(edges)
    assert fewer.count() <= len(pairs)
    got = {r["node"]: r["root"] for r in c.components(fewer).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert c.forest(edges.limit(0)).isEmpty()
