"""Succinct level-order tries: a bitvector of degrees in unary, and a label for each edge."""

from __future__ import annotations

import numpy as np

#: Bytes of a label, a digest of what stands on the edge.
LABEL = 16


def halves(raw: bytes) -> np.ndarray:
    """Digests as rows of two big-endian numbers, which sort as their bytes do."""
    return np.frombuffer(raw, ">u8").reshape(-1, LABEL // 8)


class Louds:
    """Nodes are numbered level by level from the root, 0; ``bits`` has each node's degree in ones, then a zero.

    The j-th one stands for node j + 1, the zeros before it count the nodes up to its parent.
    """

    def __init__(self, bits: np.ndarray, labels: bytes):
        self.bits, self.labels = bits, labels

    @classmethod
    def build(cls, parents: np.ndarray, depths: np.ndarray, labels: bytes) -> tuple[Louds, np.ndarray]:
        """From nodes in any order, parents as their places (-1: the root) and levels from 1; also the
        place of each numbered node but the root."""
        n, two = len(parents), halves(labels)
        number, placed = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
        by_level = np.argsort(depths, kind="stable")
        starts = np.searchsorted(depths[by_level], np.arange(1, depths.max(initial=0) + 2))
        for a, b in zip(starts, starts[1:]):
            level = by_level[a:b]
            level = level[np.lexsort((two[level, 1], two[level, 0], number[parents[level]]))]
            placed[a:b] = level
            number[level] = np.arange(a + 1, b + 1)
        degrees = np.bincount(number[parents], minlength=n + 1) if n else np.zeros(1, np.int64)  # parent -1 is the last place, number 0
        bits = np.ones(2 * n + 1, bool)
        bits[np.cumsum(degrees + 1) - 1] = False
        return cls(bits, two[placed].tobytes()), placed

    def __len__(self) -> int:
        return len(self.bits) // 2 + 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros, prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Parents of nodes 1, 2, ...: the zeros before their ones."""
        return np.cumsum(~self.bits)[self.bits]

    def levels(self) -> list[tuple[int, int]]:
        """First and last (exclusive) node of each level below the root, from above."""
        ends, degrees = [(0, 1)], np.concatenate(([0], np.cumsum(self.degrees())))
        while True:
            a, b = ends[-1]
            more = int(degrees[b] - degrees[a])
            if not more:
                return ends[1:]
            ends.append((b, b + more))

    def find(self, path: list[bytes]) -> int | None:
        """The node that a path of labels leads to."""
        node, two = 0, halves(self.labels)
        zeros = np.flatnonzero(~self.bits)
        for label in path:
            first = (zeros[node - 1] + 1 if node else 0) - node + 1  # ones before the node's own, and 1
            last = zeros[node] - node + 1
            high, low = halves(label)[0]
            a = first + int(np.searchsorted(two[first - 1 : last - 1, 0], high))
            b = first + int(np.searchsorted(two[first - 1 : last - 1, 0], high, "right"))
            node = a + int(np.searchsorted(two[a - 1 : b - 1, 1], low))
            if node >= b or two[node - 1, 1] != low:
                return None
        return node

    def pack(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, bits: bytes, labels: bytes) -> Louds:
        return cls(np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * (len(labels) // LABEL) + 1).astype(bool), labels)
