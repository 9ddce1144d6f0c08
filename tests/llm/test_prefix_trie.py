"""The trie of conversations against brute force over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from colloquy.llm import prefix_trie
from colloquy.llm.radix_tree import Direct, Few, Indexed, Tree


def plain_trie(sequences):
    """{node: row} of conversations as tuples of (role, text)."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        leaves, saved = 0, 0
        todo = [path]
        while todo:
            p = todo.pop()
            leaves += not children[p]
            saved += (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
            todo += children[p]
        return leaves, saved

    out = []
    for path, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append(
            (min(own), len(path), parent, len(own), len(children[path]), *below(path), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))

    def order(t):
        name = hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()
        return (t[0], t[1], t[2], name)

    turns = {c: tuple(t[2:] for t in sorted(own, key=order)) for c, own in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, ())[:h] + own[h:]
    return out


SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, place STRING, id INT"


def shown(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def made(seed):
    dice = random.Random(seed)
    rows = []
    for conv in [*range(60), 2**40, 2**40 + 5]:
        if conv % 20 == 0 and dice.random() < 0.5 and conv:
            continue
        for turn in range(dice.choice([1, 1, 2, 3, 5, 9])):
            rows.append((conv, turn, dice.choice(["user", "ai"]), dice.choice(["a b", "c", "", "d\x0be f", " é x "])))
    rows += [(7, None, None, None), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 0, "user", "x"), (3, None, "", "q")]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_all_prefixes(spark, monkeypatch, seed):
    rows = made(seed)
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want = plain_trie(plain_rebuilt(rows))
    got = prefix_trie.trie(prefix_trie.borrowed_heads(prefix_trie.numbered_turns(turns)))
    assert shown(got) == want
    # Short blocks, hot joins and cut conversations give the same rows.
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    monkeypatch.setattr(prefix_trie, "HOT", 3)
    got = prefix_trie.trie(prefix_trie.borrowed_heads(prefix_trie.numbered_turns(turns, max_rows=2)), max_rows=2)
    assert shown(got) == want


def test_a_long_shared_prefix(spark):
    texts = [f"w{i} v" for i in range(300)]
    ways = {c: texts[: 150 + 50 * (c % 4)] + [f"end {c}"] for c in range(8)} | {9: texts, 10: texts, 11: []}
    rows = [(c, i, "user", t) for c, own in ways.items() for i, t in enumerate(own)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    numbered = prefix_trie.numbered_turns(turns)
    none = spark.createDataFrame([(11, None, None, None)], "conv_id LONG, place LONG, id STRING, words LONG")
    want = plain_trie({c: tuple(("user", t) for t in own) for c, own in ways.items()})
    assert shown(prefix_trie.trie(numbered.unionByName(none))) == want


def test_trees_of_bounded_size_add_up(monkeypatch):
    import pyarrow as pa

    dice = random.Random(4)
    ids = [bytes([dice.randrange(3)] * 15 + [i]) for i in range(9)]
    keys = sorted({b"".join(dice.choices(ids, k=dice.randrange(6))) for _ in range(300)})
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([b""] * len(keys), pa.binary()),
            pa.array([b"top"] * len(keys), pa.binary()),
            pa.array([0] * len(keys), pa.int64()),
            pa.array(keys, pa.binary()),
            pa.array([[1] * (len(k) // 16) for k in keys], pa.list_(pa.int64())),
            pa.array([1] * len(keys), pa.int64()),
            pa.array(range(len(keys)), pa.int64()),
        ],
        ["state", "top", "block", "key", "words", "n", "conv_id"],
    )

    def nodes():
        found = defaultdict(lambda: [0, 10**9])
        for out in prefix_trie._grow(iter([batch])):
            for r in out.to_pylist():
                own = found[(r["node"], r["parent"], r["depth"])]
                own[0] += r["n_convs"]
                own[1] = min(own[1], r["conv_id"])
        return found

    want = nodes()
    monkeypatch.setattr(prefix_trie, "KEYS", 7)
    assert nodes() == want
    members = defaultdict(int)
    for k in keys:
        for d in range(0, len(k) + 1, 16):
            members[k[:d]] += 1
    assert sorted(v[0] for v in want.values()) == sorted(members.values())


def test_tree_layouts_and_walk():
    dice = random.Random(7)
    keys = {bytes(dice.randrange(256) for _ in range(dice.choice([0, 1, 2, 3]))) for _ in range(3000)}
    keys |= {b"shared path" + bytes([i]) for i in range(30)} | {b"shared"}
    tree, kinds = Tree(), set()
    for i, k in enumerate(dice.sample(sorted(keys), len(keys))):
        tree.add(k, 2, i)
    todo = [tree.root]
    while todo:
        node = todo.pop()
        kinds.add((type(node.children), getattr(node.children, "room", None)))
        todo += [n for _, n in node.children.items()]
    assert kinds == {(Few, 4), (Few, 16), (Indexed, None), (Direct, None)}
    path, ends = b"", {}
    for step in tree.walk():
        path = path[: step.at] + step.added
        ends[path] = step.count
    assert list(ends) == sorted(ends)
    assert all(ends[k] == 2 * sum(x.startswith(k) for x in keys) for k in keys if k in ends) and keys <= set(ends)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.borrowed_heads(prefix_trie.numbered_turns(empty))).count() == 0
