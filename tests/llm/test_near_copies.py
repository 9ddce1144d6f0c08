"""What the pipeline keeps of near copies against brute force over all pairs of shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from colloquy.llm import near_copies as n
from colloquy.llm.simhash import fingerprint
from test_simhash import plain_components


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    pairs = []
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((i, j))
    label = plain_components(pairs, range(len(rows)))
    kept = {}
    for i, (id, _) in enumerate(rows):
        kept[label[i]] = min(kept.get(label[i], id), id)
    return sorted(kept.values()), pairs, sets


def made(seed):
    dice = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(40))
    texts = ["", " ", "one two", "ONE  two", "a b c d e", "a b c d e f", line]
    for base in range(25):
        words = [f"w{dice.randrange(3000)}" for _ in range(dice.choice([12, 60, 200, 400]))]
        texts.append(" ".join(words))
        for _ in range(6):
            near = list(words)
            for _ in range(dice.randrange(1, 2 + len(words) // 60)):
                near[dice.randrange(len(near))] = f"x{dice.randrange(3000)}"
            if dice.random() < 0.3:
                near = near[: -dice.randrange(1, 2 + len(near) // 5)]
            texts.append(" ".join(near) + (" " + line if dice.random() < 0.2 else ""))
    # A chain of small steps, and many copies of one text.
    words = [f"c{i}" for i in range(100)]
    for i in range(0, 60, 2):
        words[i] = f"d{i}"
        texts.append(" ".join(words))
    words = [f"m{i}" for i in range(150)]
    for i in range(120):
        near = list(words)
        near[dice.randrange(150)] = f"n{i}"
        near[dice.randrange(150)] = f"n{i}"
        texts.append(" ".join(near))
    dice.shuffle(texts)
    return [(1000 - 3 * i, t) for i, t in enumerate(texts)]


def test_pipeline_drops_near_copies_beyond_two_bits(spark):
    rows = made(1)
    want, pairs, sets = plain_kept(rows)
    part = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in pairs if sets[i] | sets[j]]
    assert sum(0.8 <= p < 0.9 for p in part) > 50
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id LONG, text STRING, lang STRING").repartition(3)
    got = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == want
    assert 30 < len(want) < len(rows) / 2


@pytest.mark.parametrize("settings", [n.Settings(tile=7, shingles=300), n.Settings(common=20), n.Settings(sample=10, common=0)])
def test_nothing_is_lost_whatever_the_tile(spark, settings):
    rows = made(2)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = n.keep_one(docs, settings=settings).collect()
    assert sorted(r["doc_id"] for r in got) == plain_kept(rows)[0]


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, pairs, _ = plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == want
    assert len(pairs) == 14


def test_simhash_finds_candidates_by_itself(spark, monkeypatch):
    rows = made(3)
    sets = [plain_set(t) for _, t in rows]
    prints = [int(fingerprint(n.shingle_set(t, 5))) for _, t in rows]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 2]
    found = plain_components(near, range(len(rows)))
    _, pairs, _ = plain_kept(rows)
    label = plain_components([(i, j) for i, j in pairs if found[i] == found[j]], range(len(rows)))
    kept = {}
    for i, (id, _) in enumerate(rows):
        kept[label[i]] = min(kept.get(label[i], id), id)
    monkeypatch.setattr(n, "_candidate_links", lambda first, unique, s: spark.createDataFrame([], "a BIGINT, b BIGINT"))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    assert sorted(r["doc_id"] for r in n.keep_one(docs).collect()) == sorted(kept.values())
    assert any(sets[i] != sets[j] for i, j in near)
    assert len(plain_kept(rows)[0]) < len(kept) < len(rows)


def test_prints_never_differ_in_more_than_the_sets():
    dice = np.random.default_rng(3)
    for size in (1, 30, 400, 3000):
        a = np.unique(dice.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.r_[a[size // 9 :], dice.integers(0, 2**63, size // 9).astype(np.uint64)])
        apart = int(np.bitwise_count(n.parity(a) ^ n.parity(b)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_empty_table(no_documents):
    assert n.keep_one(no_documents).count() == 0
