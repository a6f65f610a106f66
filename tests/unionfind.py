"""Signed union-find, for small graphs and as the yardstick of the distributed forest."""

from __future__ import annotations


class SignedUnionFind:
    """Sets of items, each item with a sign. Merging keeps all signs; flipping an item flips its whole set."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.weight: list[int] = []
        self.minus: list[bool] = []  # of a root its sign, of another item whether it differs from its parent's

    def __len__(self) -> int:
        return len(self.parent)

    def add(self, negative: bool = False) -> int:
        self.parent.append(len(self.parent))
        self.weight.append(1)
        self.minus.append(negative)
        return len(self.parent) - 1

    def find(self, item: int) -> tuple[int, bool]:
        """The set's representative, and whether the item differs from it in sign."""
        path = []
        while self.parent[item] != item:
            path.append(item)
            item = self.parent[item]
        differs = False
        for x in reversed(path):
            differs = differs != self.minus[x]
            self.parent[x], self.minus[x] = item, differs
        return item, differs

    def representative(self, item: int) -> int:
        return self.find(item)[0]

    def negative(self, item: int) -> bool:
        root, differs = self.find(item)
        return self.minus[root] != differs

    def merge(self, a: int, b: int) -> int:
        (a, _), (b, _) = self.find(a), self.find(b)
        if a == b:
            return a
        if self.weight[a] < self.weight[b]:
            a, b = b, a
        self.parent[b] = a
        self.weight[a] += self.weight[b]
        self.minus[b] = self.minus[b] != self.minus[a]
        return a

    def flip(self, item: int) -> None:
        root = self.representative(item)
        self.minus[root] = not self.minus[root]
