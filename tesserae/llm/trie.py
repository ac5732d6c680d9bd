"""A path-compressed trie of sorted hash sets with a similarity search that shares partial overlaps.

Sets are stored in one order for all of a trie, so sets that begin alike share a path and the overlap along it is
computed once for a probe. Ordered by frequency among them (Vocabulary), sets that share much share long paths. A subtree is left as soon as the overlap so far, plus the most that the remaining lengths of
probe and subtree allow, is less than the similarity needs.
"""

from __future__ import annotations

import numpy as np

_STEP = 256


class Vocabulary:
    """The order of the items of some sets: frequent ones first, ties by hash. An item's rank is its place in the order."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate([np.empty(0, np.uint64), *sets])
        self.items, count = np.unique(every, return_counts=True)
        self.rank = np.empty(len(count), np.int64)
        self.rank[np.argsort(-count, kind="stable")] = np.arange(len(count))

    def ranks(self, items: np.ndarray) -> np.ndarray:
        """Ascending ranks of the items that are in the vocabulary."""
        if not len(self.items):
            return np.empty(0, np.int64)
        at = np.minimum(self.items.searchsorted(items), len(self.items) - 1)
        return np.sort(self.rank[at[self.items[at] == items]])


class _Node:
    __slots__ = ("ends", "kids", "rest", "seg", "small")

    def __init__(self, seg: np.ndarray):
        self.seg, self.kids, self.ends, self.rest, self.small = seg, {}, [], 0, 1 << 62


class SetTrie:
    """num/den: the least Jaccard similarity. Empty sets are stored nowhere and match nothing."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.root, self.size = num, den, _Node(np.empty(0, np.int64)), {}

    def add(self, key, items: np.ndarray) -> None:
        if not len(items):
            return
        self.size[key] = n = len(items)
        node, at = self.root, 0
        while True:
            node.rest, node.small = max(node.rest, n - at), min(node.small, n)
            if at == n:
                node.ends.append(key)
                return
            head = int(items[at])
            kid = node.kids.get(head)
            if kid is None:
                kid = node.kids[head] = _Node(items[at:])
                kid.small = n
                kid.ends.append(key)
                return
            m = min(len(kid.seg), n - at)
            differs = np.flatnonzero(kid.seg[:m] != items[at : at + m])
            same = int(differs[0]) if len(differs) else m
            if same < len(kid.seg):  # split the path
                upper = _Node(kid.seg[:same])
                upper.rest, upper.small = kid.rest + len(kid.seg) - same, kid.small
                kid.seg = kid.seg[same:]
                upper.kids[int(kid.seg[0])] = kid
                node.kids[head] = kid = upper
            node, at = kid, at + same

    def search(self, items: np.ndarray, n: int | None = None, first: bool = False) -> list[tuple[object, int]]:
        """(key, overlap) of the stored sets that are similar enough; with first, one of them at most.

        n: the size of the searching set, where items are only those of it that the stored sets can hold.
        """
        found: list[tuple[object, int]] = []
        most = len(items)
        n = most if n is None else n
        if not most:
            return found
        num, both = self.num, self.num + self.den
        todo = [(self.root, 0, 0)]
        while todo:
            node, overlap, at = todo.pop()
            need = -(-num * (n + node.small) // both)
            seg, lost = node.seg, False
            for s in range(0, len(seg), _STEP):
                part = seg[s : s + _STEP]
                where = items.searchsorted(part)
                inside = where < most
                overlap += int(np.count_nonzero(items[where[inside]] == part[inside]))
                at = int(items.searchsorted(part[-1], "right"))
                if overlap + min(most - at, len(seg) - s - len(part) + node.rest) < need:
                    lost = True
                    break
            if lost:
                continue
            for key in node.ends:
                if overlap * both >= num * (n + self.size[key]):
                    found.append((key, overlap))
                    if first:
                        return found
            todo.extend((kid, overlap, at) for kid in node.kids.values())
        return found
