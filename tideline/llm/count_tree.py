"""R-tree over count vectors, and the join of a bounded group of sets by it (numpy, inside tasks).

The elements of a set are hashed into groups; the numbers of elements per group are the set's point.  Two sets share at
most the sum of the coordinate minima of their points, and a set shares with no set of a box more than the sum of minima
with the box's upper corner.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

GROUPS = 256
#: Points of a leaf and children of an inner node.
LEAF, FANOUT = 16, 8


def point(marks: np.ndarray, groups: int = GROUPS) -> bytes:
    """Counts per group, one byte each if they fit, else four."""
    counts = np.bincount((marks % np.uint64(groups)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def unpacked(points: list[bytes], groups: int = GROUPS) -> np.ndarray:
    kinds = {groups: np.uint8, 4 * groups: np.uint32}
    out = np.empty((len(points), groups), np.uint8 if all(len(p) == groups for p in points) else np.uint32)
    for i, p in enumerate(points):
        out[i] = np.frombuffer(p, kinds[len(p)])
    return out


def least_shared(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Elements that sets of sizes ``a`` and ``b`` must share to be linked."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """Packed R-tree: points in an order in which every node holds a run of them; nodes know corners and sizes."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.concatenate(_packed(np.arange(len(sizes)), sizes, counts)) if len(sizes) else np.empty(0, np.int64)
        self.sizes, self.counts = sizes[self.order].astype(np.int64), counts[self.order]
        self.label = np.arange(len(sizes))
        self.levels = []
        starts = np.arange(0, len(sizes), LEAF)
        while True:
            corner = np.maximum.reduceat(self.counts, starts) if len(starts) else self.counts
            least, most = (f.reduceat(self.sizes, starts) if len(starts) else self.sizes for f in (np.minimum, np.maximum))
            self.levels.append((starts, corner, least, most))
            if len(starts) <= FANOUT:
                break
            starts = starts[::FANOUT]
        self._settle()

    def _settle(self) -> None:
        """The label of every node whose points all have it, else -1."""
        self.common = []
        for starts, *_ in self.levels:
            low, high = np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts)
            self.common.append(np.where(low == high, low, -1))

    def _may_link(self, x: int, counts: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether the point may be linked with one of each box, given by upper corner and sizes; and the bound."""
        a, p = self.sizes[x], self.percent
        fits = (100 * most >= p * a) & (100 * a >= p * least)
        shared = np.minimum(self.counts[x], counts).sum(axis=1, dtype=np.int64)
        need = least_shared(a, np.maximum(least, -(-p * a // 100)), p)
        return np.where(fits & (shared >= need), shared, -1)

    def before(self, x: int) -> np.ndarray:
        """Places before ``x`` that may be linked with it and do not have its label yet, the likeliest first."""
        mine = self.label[x]
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            starts, corner, least, most = self.levels[depth]
            nodes = nodes[(starts[nodes] < x) & (self.common[depth][nodes] != mine)]
            if not len(nodes):
                return nodes
            nodes = nodes[self._may_link(x, corner[nodes], least[nodes], most[nodes]) >= 0]
            step, end = (FANOUT, len(self.levels[depth - 1][0])) if depth else (LEAF, x)
            nodes = (nodes[:, None] * step + np.arange(step)).ravel()
            nodes = nodes[nodes < end]
        nodes = nodes[self.label[nodes] != mine]
        shared = self._may_link(x, self.counts[nodes], self.sizes[nodes], self.sizes[nodes])
        nodes, shared = nodes[shared >= 0], shared[shared >= 0]
        return nodes[np.argsort(-shared, kind="stable")]

    def unite(self, x: int, y: int) -> None:
        self.label[self.label == self.label[y]] = self.label[x]
        self._settle()


def _packed(at: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Halves along the coordinate (or the size) that spreads most, down to leaves; halves are whole leaves."""
    if len(at) <= LEAF:
        return [at]
    here = counts[at]
    spread = here.max(axis=0).astype(np.int64) - here.min(axis=0)
    axis = int(spread.argmax())
    along = sizes[at] if np.ptp(sizes[at]) >= spread[axis] else here[:, axis]
    half = -(-len(at) // (2 * LEAF)) * LEAF
    ranked = at[np.argsort(along, kind="stable")]
    return _packed(ranked[:half], sizes, counts) + _packed(ranked[half:], sizes, counts)


def spanning_links(
    sizes: np.ndarray, counts: np.ndarray, percent: int, linked: Callable[[int, int], bool] | None = None, side: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links that connect whatever the links among the sets connect; a set is not compared with those it is connected to.

    ``linked`` decides a pair that the bound leaves (every such pair counts without it); with ``side``, only sets of
    different sides are compared.
    """
    tree, links = CountTree(sizes, counts, percent), []
    order = tree.order.tolist()
    for x in range(1, len(order)):
        near = tree.before(x)
        if side is not None:
            near = near[side[tree.order[near]] != side[order[x]]]
        while len(near):
            y = int(near[0])
            if linked is None or linked(order[x], order[y]):
                links.append((order[x], order[y]))
                tree.unite(x, y)
                near = near[tree.label[near] != tree.label[x]]
            else:
                near = near[1:]
    return links
