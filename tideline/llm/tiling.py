"""Greedy string tiling between word sequences (numpy, inside tasks)."""

from __future__ import annotations

import heapq

import numpy as np

from .textkit import plain_word_keys, windows

#: Shortest tile in words, and the share of a test item's words that tiles must cover.
MIN_MATCH, MIN_COVERAGE = 5, 0.5


def segments(p: np.ndarray, q: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, position in the text, position in the item) from equal seed windows.

    Seeds that follow each other on one diagonal grow into one run.
    """
    order = np.lexsort((q, p - q))
    p, q = p[order], q[order]
    cut = np.flatnonzero((np.diff(p - q) != 0) | (np.diff(q) != 1)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(q)]])
    return [(int(z - a) + min_match - 1, int(p[a]), int(q[a])) for a, z in zip(starts, ends, strict=True)]


def tile(found: list[tuple[int, int, int]], n_item: int, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles, longest first: each marks its words in both sequences; what is left of an overlapped run is tried again."""
    heap = [(-n, p, q) for n, p, q in found]
    heapq.heapify(heap)
    base = min((p for _, p, _ in found), default=0)
    marked_text = np.zeros(max((p + n for n, p, _ in found), default=0) - base, bool)
    marked_item = np.zeros(n_item, bool)
    tiles = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        free = ~(marked_text[p - base : p - base + n] | marked_item[q : q + n])
        if free.all():
            marked_text[p - base : p - base + n] = True
            marked_item[q : q + n] = True
            tiles.append((n, p, q))
            continue
        edge = np.diff(np.concatenate([[0], free.view(np.int8), [0]]))
        for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if z - a >= min_match:
                heapq.heappush(heap, (a - z, p + a, q + a))
    return tiles


class TestItems:
    """Seed index over a block of test items."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int = MIN_MATCH) -> None:
        self.min_match = min_match
        self.ids, self.sizes, seeds, owner, place = [], [], [], [], []
        for item, text in items:
            keys = plain_word_keys(text)
            grams = windows(keys, min_match)
            if len(grams):
                owner.append(np.full(len(grams), len(self.ids)))
                place.append(np.arange(len(grams)))
                seeds.append(grams)
                self.ids.append(item)
                self.sizes.append(len(keys))
        flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, np.int64))[order]

    def matches(self, text: str | None, min_coverage: float = MIN_COVERAGE) -> list[tuple[int, float, int, int]]:
        """(item id, covered share, tiles, longest tile) of the items that the text covers enough of."""
        grams = windows(plain_word_keys(text), self.min_match)
        if not len(grams) or not len(self.seeds):
            return []
        low = np.searchsorted(self.seeds, grams, "left")
        times = np.searchsorted(self.seeds, grams, "right") - low
        hits = np.flatnonzero(times)
        if not len(hits):
            return []
        p = np.repeat(hits, times[hits])
        at = np.repeat(low[hits], times[hits]) + np.arange(len(p)) - np.repeat(np.cumsum(times[hits]) - times[hits], times[hits])
        owner, q = self.owner[at], self.place[at]
        out = []
        for i in np.unique(owner).tolist():
            mine, size = owner == i, self.sizes[i]
            # Words of the item in any seed: no tiling covers more.
            reach = np.zeros(size + 1, np.int64)
            first = np.unique(q[mine])
            np.add.at(reach, first, 1)
            np.add.at(reach, first + self.min_match, -1)
            if np.count_nonzero(np.cumsum(reach)[:-1]) < min_coverage * size:
                continue
            tiles = tile(segments(p[mine], q[mine], self.min_match), size, self.min_match)
            covered = sum(n for n, _, _ in tiles)
            if covered >= min_coverage * size:
                out.append((self.ids[i], covered / size, len(tiles), max(n for n, _, _ in tiles)))
        return out
