"""An adaptive radix tree over byte keys that arrive in order, each with its row number.

Inner nodes hold the compressed path to them and grow with their children: up to 4 and up to 16 sorted bytes,
a 256-byte index into 48 places, 256 places. Every node knows the first and last row below it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """Children of up to 4 or up to 16 bytes: the bytes in order, and the children beside them."""

    __slots__ = ("room", "bytes", "places")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.places = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.places[at] if at >= 0 else None

    def put(self, byte: int, child) -> bool:
        """False if there is no room for another byte."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.places[at] = child
        elif len(self.bytes) == self.room:
            return False
        else:
            self.bytes.insert(at, byte)
            self.places.insert(at, child)
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return zip(self.bytes, self.places, strict=True)

    def grown(self):
        return Sorted(16) if self.room == 4 else Indexed()


class Indexed:
    """Children of up to 48 bytes: an index by byte into the places."""

    __slots__ = ("index", "places")

    def __init__(self):
        self.index, self.places = bytearray(256), []

    def get(self, byte: int):
        at = self.index[byte]
        return self.places[at - 1] if at else None

    def put(self, byte: int, child) -> bool:
        if at := self.index[byte]:
            self.places[at - 1] = child
        elif len(self.places) == 48:
            return False
        else:
            self.places.append(child)
            self.index[byte] = len(self.places)
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return ((byte, self.places[at - 1]) for byte, at in enumerate(self.index) if at)

    def grown(self):
        return Direct()


class Direct:
    """A place for every byte."""

    __slots__ = ("places",)

    def __init__(self):
        self.places = [None] * 256

    def get(self, byte: int):
        return self.places[byte]

    def put(self, byte: int, child) -> bool:
        self.places[byte] = child
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return ((byte, child) for byte, child in enumerate(self.places) if child is not None)


class Node:
    """``path``: bytes from the parent, its branching byte included; rows ``first`` to ``last``; ``kids`` None: a leaf."""

    __slots__ = ("path", "kids", "first", "last")

    def __init__(self, path: bytes, first: int, kids=None):
        self.path, self.first, self.last, self.kids = path, first, first, kids

    def add(self, byte: int, child: Node) -> None:
        if self.kids is None:
            self.kids = Sorted()
        while not self.kids.put(byte, child):
            kids = self.kids.grown()
            for held in self.kids.items():
                kids.put(*held)
            self.kids = kids


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the common beginning of two byte strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class RadixTree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, row: int) -> None:
        """Adds a key at least as large as all before it, as the next row."""
        if self.root is None:
            self.root = Node(b"", row)
        node, at = self.root, 0
        while True:
            # The whole path of ``node`` lies on the key here.
            node.last = row
            if at == len(key):
                return
            child = node.kids.get(key[at]) if node.kids is not None else None
            if child is None:
                node.add(key[at], Node(key[at:], row))
                return
            same = shared_length(child.path, key[at:])
            if same < len(child.path):  # the path splits
                upper = Node(child.path[:same], child.first)
                child.path = child.path[same:]
                upper.add(child.path[0], child)
                node.add(key[at], upper)
                child = upper
            node, at = child, at + same

    def walk(self) -> Iterator[tuple[int, int, int, int]]:
        """(depth above, depth, first row, last row) in bytes of every node, parents and lower keys first."""
        stack = [(0, self.root)] if self.root is not None else []
        while stack:
            above, node = stack.pop()
            depth = above + len(node.path)
            yield above, depth, node.first, node.last
            if node.kids is not None:
                stack.extend((depth, child) for _, child in reversed(list(node.kids.items())))
