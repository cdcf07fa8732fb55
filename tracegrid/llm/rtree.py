"""Packed R-trees over group-count vectors, joined under an overlap bound; many trees at once.

A set of hashes becomes a point: how many of them fall into each of ``GROUPS`` groups. The overlap of two sets is
at most the sum over groups of the smaller count; over the boxes of two nodes, of the smaller of both upper
corners. A pair can reach Jaccard p/q only if its overlap is at least p * (a + b) / (p + q), so a pair of nodes is
dropped when the bound misses that for its smallest sizes, or when all its points carry one mark.

The trees of many small tiles lie in the same arrays: a level's nodes are ranges of the level below, no node
spans two trees, and a join goes down all of them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUPS = 1024
FAN = 16
#: Pairs whose vectors are compared at once; bounds the memory of a join.
STEP = 8192


def count_vector(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=GROUPS)


def pack_vector(counts: np.ndarray) -> bytes:
    """In the narrowest of 1, 2 or 4 bytes a group."""
    top = counts.max(initial=0)
    return counts.astype(np.uint8 if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def unpack_vectors(packed: list[bytes]) -> np.ndarray:
    """One row for each; of the widest kind among them."""
    kinds = {GROUPS: np.dtype(np.uint8), 2 * GROUPS: np.dtype("<u2"), 4 * GROUPS: np.dtype("<u4")}
    sizes = np.array([len(x) for x in packed], dtype=np.int64)
    out = np.empty((len(packed), GROUPS), dtype=kinds[int(sizes.max(initial=GROUPS))])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join([packed[i] for i in at]), dtype=kinds[int(size)]).reshape(-1, GROUPS)
    return out


def overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of rows with rows."""
    return np.minimum(x, y).sum(1, dtype=np.int64)


def may_link(bound: np.ndarray, a: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether sets of sizes a and b with at most this overlap can have a Jaccard of p/q; the sizes' ratio counts too."""
    return (bound * (p + q) >= p * (a + b)) & (np.minimum(a, b) * q >= p * np.maximum(a, b))


class Forest:
    """Trees over points that are sorted by tree; within a tree, points are packed by size, then by the heaviest group."""

    def __init__(self, tree: np.ndarray, points: np.ndarray, sizes: np.ndarray, marks: np.ndarray):
        order = np.lexsort((points.argmax(1), sizes, tree))
        self.order, self.trees = order, np.unique(tree)
        tree = tree[order]
        #: Each level: upper corners, least size, largest size, mark (-1: several), tree, first child, end of children.
        self.levels = [(points[order], sizes[order], sizes[order], marks[order], tree, None, None)]
        while len(tree) > len(self.trees):
            place = np.arange(len(tree)) - np.searchsorted(tree, tree)  # within the tree
            starts = np.flatnonzero(place % FAN == 0)
            box, least, largest, mark, *_ = self.levels[-1]
            low, high = np.minimum.reduceat(mark, starts), np.maximum.reduceat(mark, starts)
            tree = tree[starts]
            self.levels.append((
                np.maximum.reduceat(box, starts, axis=0), np.minimum.reduceat(least, starts), np.maximum.reduceat(largest, starts),
                np.where(low == high, low, -1), tree, starts, np.r_[starts[1:], len(place)],
            ))

    def _kept(self, k: int, i: np.ndarray, j: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of nodes of level k, those that may hold a pair of different marks that links."""
        box, least, largest, mark, *_ = self.levels[k]
        ok = ((mark[i] != mark[j]) | (mark[i] == -1)) & (largest[i] * q >= p * least[j]) & (largest[j] * q >= p * least[i])
        i, j = i[ok], j[ok]
        ok = overlap_bound(box[i], box[j]) * (p + q) >= p * (least[i] + least[j])
        return i[ok], j[ok]

    def _children(self, k: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children of pairs of nodes of level k; of a node with itself, each pair once."""
        first, end = self.levels[k][5:]
        di, dj = end[i] - first[i], end[j] - first[j]
        n = di * dj
        pair = np.repeat(np.arange(len(i)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = first[i][pair] + at // dj[pair], first[j][pair] + at % dj[pair]
        ok = (i[pair] != j[pair]) | (x <= y)
        return x[ok], y[ok]

    def join(self, left: np.ndarray, right: np.ndarray, p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that may link and have different marks, of the trees left[i] with right[i]; a tree with itself gives each once."""
        top = len(self.levels) - 1
        stack = [(top, np.searchsorted(self.trees, left), np.searchsorted(self.trees, right))]
        while stack:
            k, i, j = stack.pop()
            if len(i) > STEP:
                stack += [(k, i[at : at + STEP], j[at : at + STEP]) for at in range(0, len(i), STEP)]
                continue
            if not k:
                apart = i != j
                i, j = i[apart], j[apart]
            i, j = self._kept(k, i, j, p, q)
            if not len(i):
                continue
            if k:
                stack += [(k - 1, *self._children(k, i[at : at + 512], j[at : at + 512])) for at in range(0, len(i), 512)]
            else:
                yield self.order[i], self.order[j]
