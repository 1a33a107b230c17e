"""Word, shingle and key arrays: numpy helpers that run inside tasks.

A word's key is a polynomial of its code points modulo 2**64, read off prefix sums, then mixed.  All words of a text
come from a handful of array operations; no Python object is made per word.
"""

from __future__ import annotations

import re

import numpy as np

#: Words as maximal runs of anything but ASCII white space.
RUNS = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Code points from here on are letters to every table below.
LAST = 0x3000

_PLAIN_CLASS = np.array([*(re.match(r"\w", chr(c)) is not None for c in range(LAST)), True])
_RUN_CLASS = np.array([*(RUNS.match(chr(c)) is not None for c in range(LAST)), True])
_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _series(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        steps = np.full(size, _BASE, np.uint64)
        back = np.full(size, _INVERSE, np.uint64)
        steps[0] = back[0] = 1
        _powers, _inverses = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def run_keys(points: np.ndarray, table: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, starts and ends of the maximal runs of code points that ``table`` marks.

    With ``heads``, keys also of the first so many code points of the runs longer than that, apart from those of runs
    spelt so; starts and ends remain those of the runs.
    """
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = table.take(points, mode="clip")
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers, inverses = _series(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], out=sums[1:])
    sizes = ends - starts
    before, back = sums[starts], inverses[starts]
    parts = [(sums[ends] - before) * back + sizes.astype(np.uint64)]
    for head in heads:
        longer = np.flatnonzero(sizes > head)
        parts.append((sums[starts[longer] + head] - before[longer]) * back[longer] + np.uint64(head))
    keys = mix(np.concatenate(parts))
    np.invert(keys[len(starts) :], out=keys[len(starts) :])
    return keys, starts, ends


def run_word_keys(points: np.ndarray) -> np.ndarray:
    """Keys of the words ``[^\\x20\\x09-\\x0D]+``."""
    return run_keys(points, _RUN_CLASS)[0]


def lowered_run_keys(text: str) -> np.ndarray:
    """The same after A-Z became a-z."""
    points = code_points(text)
    return run_word_keys(np.where(points < 128, _LOWER.take(points, mode="clip"), points))


def plain_word_keys(text: str | None) -> np.ndarray:
    """Keys of lower-case runs of letters, digits and underscores: case and punctuation do not count."""
    return run_keys(code_points(text.lower()), _PLAIN_CLASS)[0] if text else np.empty(0, np.uint64)


def plain_keys_and_heads(text: str | None, heads: tuple[int, ...]) -> np.ndarray:
    """The same with the keys of the words' heads."""
    return run_keys(code_points(text.lower()), _PLAIN_CLASS, heads)[0] if text else np.empty(0, np.uint64)


def plain_words(text: str | None) -> list[str]:
    """The words behind ``plain_word_keys``."""
    if not text:
        return []
    text = text.lower()
    _, starts, ends = run_keys(code_points(text), _PLAIN_CLASS)
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def windows(keys: np.ndarray, size: int) -> np.ndarray:
    """Key of every run of ``size`` words, in order; empty if there are fewer words."""
    n = len(keys) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = keys[:n].copy()
    for j in range(1, size):  # wraps around: arithmetic is modulo 2**64
        out *= np.uint64(_BASE)
        out += keys[j : j + n]
    return mix(out)


def shingles(keys: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Window keys; a text with fewer words has one shingle of all of them, one without words none."""
    return windows(keys, min(size, len(keys))) if len(keys) else np.empty(0, np.uint64)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return (np.right_shift(x, np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
