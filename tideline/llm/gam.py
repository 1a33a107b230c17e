"""Generalised additive model with pairwise interactions: cyclic boosting of shallow trees into lookup tables (numpy)."""

from __future__ import annotations

import itertools

import numpy as np

from .textkit import _PLAIN_CLASS, _RUN_CLASS, code_points, run_keys, windows

FEATURES = (
    "log_words", "word_length", "long_words", "short_words", "upper", "digits", "marks", "symbols", "pipes", "shouts", "distinct", "top_word", "repeats",
    "twins", "line_words", "same_lines", "bare_words", "beyond_ascii", "entropy", "sentence_words",
)
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES, RIDGE = 120, 60, 10, 0.15, 3, 5.0


def _members(chars: str) -> np.ndarray:
    table = np.zeros(0x3001, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER = np.array([*(chr(c).isupper() for c in range(0x3000)), False])
_DIGIT = np.array([*(chr(c).isdigit() for c in range(0x3000)), False])
_MARKS, _SYMBOLS, _ENDS = _members(".,;:!?"), _members("#*$%&|<>@^~_=+/\\`"), _members(".!?")


def describe(text: str | None) -> np.ndarray:
    """The features of a text; all zero for one without words."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    points = code_points(text)
    keys, starts, ends = run_keys(points, _RUN_CLASS)
    n = len(keys)
    if not n:
        return out
    sizes, chars = ends - starts, len(points)
    share = lambda table: float(np.count_nonzero(table.take(points, mode="clip"))) / chars
    _, times = np.unique(keys, return_counts=True)
    grams = windows(keys, 8)
    _, gram_times = np.unique(grams, return_counts=True)
    lines = [x for x in text.split("\n") if x.strip()]
    plain = np.zeros(chars + 1, np.int64)
    np.cumsum(_PLAIN_CLASS.take(points, mode="clip"), out=plain[1:])
    bare = plain[ends] - plain[starts] == sizes
    _, counts = np.unique(points, return_counts=True)
    p = counts / chars
    out[:] = (
        np.log1p(n), sizes.mean(), np.mean(sizes > 12), np.mean(sizes <= 3), share(_UPPER), share(_DIGIT), share(_MARKS), share(_SYMBOLS),
        np.count_nonzero(points == 124) / n, np.count_nonzero(points == 33) / n, len(times) / n, times.max() / n,
        gram_times[gram_times > 1].sum() / len(grams) if len(grams) else 0.0, np.mean(keys[1:] == keys[:-1]) if n > 1 else 0.0,
        n / max(1, len(lines)), 1.0 - len(set(lines)) / max(1, len(lines)), bare.mean(), np.mean(points > 127), -np.sum(p * np.log2(p)),
        n / (1.0 + np.count_nonzero(_ENDS.take(points[ends - 1], mode="clip"))),
    )
    return out


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of the bins under a tree of a few leaves: the best cut of the best segment, again and again."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    gain = lambda a, z: (cg[z] - cg[a]) ** 2 / (ch[z] - ch[a] + RIDGE)
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best = (1e-9, -1)
        for a, z in itertools.pairwise(cuts):
            mid = np.arange(a + 1, z)
            if len(mid):
                won = gain(a, mid) + gain(mid, z) - gain(a, z)
                i = int(np.argmax(won))
                best = max(best, (float(won[i]), int(mid[i])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, z in itertools.pairwise(cuts):
        out[a:z] = (cg[z] - cg[a]) / (ch[z] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a grid under the tree of one cut each way with the largest gain."""
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    part = lambda c: (c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    parts = list(zip(part(cg), part(ch), strict=True))
    gain = sum(a**2 / (b + RIDGE) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [float(a[i, j] / (b[i, j] + RIDGE)) for a, b in parts]
    out = np.zeros(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out


class AdditiveModel:
    """Offset, a table per feature, and a table per chosen pair of features."""

    def __init__(self, offset: float, edges: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int]], grids: list[np.ndarray]) -> None:
        self.offset, self.edges, self.tables, self.coarse, self.pairs, self.grids = offset, edges, tables, coarse, pairs, grids

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries, a column of bins at a time."""
        out = np.full(len(x), self.offset)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edge, x[:, j], "right")]
        small = [np.searchsorted(edge, x[:, j], "right") for j, edge in enumerate(self.coarse)]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[small[a], small[b]]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, n_pairs: int = PAIRS) -> AdditiveModel:
    """Features in turn, a small step each, for many rounds; then pairs on what the features leave."""
    n, d = x.shape
    cut = lambda j, k: np.unique(np.quantile(x[:, j], np.arange(1, k) / k)) if n else np.empty(0)
    edges, coarse = [cut(j, BINS) for j in range(d)], [cut(j, PAIR_BINS) for j in range(d)]
    rate = (np.sum(w * y) + 0.5) / (np.sum(w) + 1.0)
    offset = float(np.log(rate / (1 - rate)))
    model = AdditiveModel(offset, edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if not n or len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    score = np.full(n, offset)

    def steps() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-score))
        return w * (y - p), w * p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = steps()
            size = len(edges[j]) + 1
            move = RATE * _shallow(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), LEAVES)
            model.tables[j] += move
            score += move[bins[j]]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        rows, cols = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(small[a] * cols + small[b], v, rows * cols).reshape(rows, cols)

    g, h = steps()
    gains = []
    for a, b in itertools.combinations(range(d), 2):
        if len(coarse[a]) and len(coarse[b]):
            gg, hh = grid(a, b, g), grid(a, b, h)
            gains.append((float(np.sum(_quadrants(gg, hh) * gg)), -a, -b))
    model.pairs = [(-a, -b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    model.grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for i, (a, b) in enumerate(model.pairs):
            g, h = steps()
            move = RATE * _quadrants(grid(a, b, g), grid(a, b, h))
            model.grids[i] += move
            score += move[small[a], small[b]]
    return model
