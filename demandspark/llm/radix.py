"""An adaptive radix tree over byte strings."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

#: Children that a node of each layout has at most: sorted bytes searched one by one, sorted bytes
#: bisected, an index of 256 slots, 256 children.
LAYOUTS = (4, 16, 48, 256)


class Node:
    """``path`` is what all keys below share after the byte that leads here (path compression)."""

    __slots__ = ("path", "keys", "kids", "n", "value")

    def __init__(self, path: bytes):
        self.path = path
        self.keys: bytearray | None = bytearray()
        self.kids: list[Node | None] = []
        self.n = 0
        self.value = None

    @property
    def layout(self) -> int:
        if self.keys is None:
            return 256
        return 48 if len(self.keys) == 256 else 4 if len(self.kids) <= 4 else 16

    def kid(self, byte: int) -> Node | None:
        keys = self.keys
        if keys is None:
            return self.kids[byte]
        if len(keys) == 256:
            return self.kids[keys[byte] - 1] if keys[byte] else None
        at = keys.find(byte) if self.n <= 4 else bisect_left(keys, byte)
        return self.kids[at] if 0 <= at < self.n and keys[at] == byte else None

    def add(self, byte: int, kid: Node) -> None:
        """A new child; the layout grows with their number."""
        if self.keys is not None and self.n == 16:
            slots = bytearray(256)
            for i, b in enumerate(self.keys):
                slots[b] = i + 1
            self.keys = slots
        elif self.keys is not None and self.n == 48:
            kids: list[Node | None] = [None] * 256
            for b in range(256):
                if self.keys[b]:
                    kids[b] = self.kids[self.keys[b] - 1]
            self.keys, self.kids = None, kids
        self.n += 1
        if self.keys is None:
            self.kids[byte] = kid
        elif len(self.keys) == 256:
            self.kids.append(kid)
            self.keys[byte] = self.n
        else:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)

    def children(self) -> Iterator[tuple[int, Node]]:
        """(byte, child) by byte."""
        if self.keys is None:
            yield from ((b, k) for b, k in enumerate(self.kids) if k is not None)
        elif len(self.keys) == 256:
            yield from ((b, self.kids[i - 1]) for b, i in enumerate(self.keys) if i)
        else:
            yield from zip(self.keys, self.kids)


class Tree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def at(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if there is none."""
        node, i = self.root, 0
        while True:
            path = node.path
            if not key.startswith(path, i):
                m = 0
                while i + m < len(key) and key[i + m] == path[m]:
                    m += 1
                low = Node(path[m + 1 :])
                low.keys, low.kids, low.n, low.value = node.keys, node.kids, node.n, node.value
                node.path, node.keys, node.kids, node.n, node.value = path[:m], bytearray(), [], 0, None
                node.add(path[m], low)
                path = node.path
            i += len(path)
            if i == len(key):
                return node
            kid = node.kid(key[i])
            if kid is None:
                kid = Node(key[i + 1 :])
                node.add(key[i], kid)
                return kid
            node, i = kid, i + 1

    def walk(self) -> list[tuple[Node, bytes, int]]:
        """(node, its key, place of its parent in the list or -1), parents before their children."""
        out = [(self.root, self.root.path, -1)]
        i = 0
        while i < len(out):
            node, key, _ = out[i]
            out.extend((kid, key + bytes((b,)) + kid.path, i) for b, kid in node.children())
            i += 1
        return out
