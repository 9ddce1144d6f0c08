"""Adaptive radix trees over byte keys.

A node has one of four layouts, the smallest that holds its children: up to 4 or 16 bytes in order, an index of
256 places into up to 48 children, or a place for every byte. Bytes that all keys below a node share are kept in the
node itself (path compression), so a tree has no more than two nodes per key, however long keys are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

NONE = 255


class Few:
    """Bytes in order, and their children beside them."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Few | Indexed:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.room:
            grown = Few(16) if self.room == 4 else Indexed()
            for b, n in self.items():
                grown.put(b, n)
            return grown.put(byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.nodes)


class Indexed:
    """For every byte the place of its child among up to 48."""

    __slots__ = ("places", "nodes")

    def __init__(self):
        self.places, self.nodes = bytearray([NONE]) * 256, []

    def get(self, byte: int) -> Node | None:
        at = self.places[byte]
        return None if at == NONE else self.nodes[at]

    def put(self, byte: int, node: Node) -> Indexed | Direct:
        if self.places[byte] != NONE:
            self.nodes[self.places[byte]] = node
            return self
        if len(self.nodes) == 48:
            grown = Direct()
            for b, n in self.items():
                grown.nodes[b] = n
            return grown.put(byte, node)
        self.places[byte] = len(self.nodes)
        self.nodes.append(node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.nodes[at]) for b, at in enumerate(self.places) if at != NONE)


class Direct:
    """A child or none for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Direct:
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Node:
    """`shared` are the bytes after the one that leads here; `count` and `least` are of the key that ends here
    until `Tree.walk` adds those of the keys below."""

    __slots__ = ("shared", "count", "least", "children")

    def __init__(self, shared: bytes, count: int = 0, least: int | None = None):
        self.shared, self.count, self.least, self.children = shared, count, least, Few()


class Step(NamedTuple):
    """A node reached: the bytes from the parent node's end to its own, where they begin, and what is at or below it."""

    at: int
    added: bytes
    count: int
    least: int


def _lower(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def add(self, key: bytes, count: int, least: int) -> None:
        """Key with how many have it and the least of those; adding it again adds up."""
        above, node, at = None, self.root, 0
        while True:
            shared = node.shared
            if key[at : at + len(shared)] != shared:
                same = next(
                    i for i in range(len(shared)) if at + i == len(key) or key[at + i] != shared[i]
                )
                fork = Node(shared[:same])
                fork.children = fork.children.put(shared[same], node)
                node.shared = shared[same + 1 :]
                above.children = above.children.put(key[at - 1], fork)
                node = fork
            at += len(node.shared)
            if at == len(key):
                node.count += count
                node.least = _lower(node.least, least)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children = node.children.put(key[at], Node(key[at + 1 :], count, least))
                return
            above, node, at = node, child, at + 1

    def walk(self) -> Iterator[Step]:
        """Nodes in order of their keys, each before those below it. A tree is walked once."""
        order: list[tuple[Node, int, bytes, Node | None]] = []
        stack: list[tuple[Node, int, bytes, Node | None]] = [(self.root, 0, self.root.shared, None)]
        while stack:
            node, at, added, above = stack.pop()
            order.append((node, at, added, above))
            end = at + len(added)
            below = [(n, end, bytes([b]) + n.shared, node) for b, n in node.children.items()]
            stack.extend(reversed(below))
        for node, _, _, above in reversed(order):
            if above is not None:
                above.count += node.count
                above.least = _lower(above.least, node.least)
        for node, at, added, _ in order:
            yield Step(at, added, node.count, node.least)
