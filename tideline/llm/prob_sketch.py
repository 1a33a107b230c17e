"""ProbMinHash signatures of weighted shingle sets, many documents at a time (numpy, inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np

from .count_tree import point
from .textkit import SHINGLE_WORDS, code_points, mix, plain_word_keys, shingles, uniform

BANDS, ROWS = 25, 5
_STEP = np.uint64(0xD1B54A32D192ED03)


def content_key(text: str | None, keys: np.ndarray) -> bytes:
    """128 bits that agree for texts with the same words in the same order; texts without words are named by their characters."""
    raw = keys.tobytes() if len(keys) else b"\0" + code_points(text or "").tobytes()
    return hashlib.blake2b(raw, digest_size=16).digest()


def distinct(keys: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingles, sorted.  All weigh the same in the sketch: then registers agree with the set Jaccard by which
    pairs are verified, however often a text repeats a passage."""
    return np.unique(shingles(keys, size))


def signatures(marks: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """(n_docs, registers) elements; two documents agree in a register with their probability Jaccard similarity.

    Every element is a Poisson process with its weight as rate: arrivals come at sums of exponential gaps and fall on a
    random register, which keeps the element of its first arrival.  Arrivals are drawn in rounds for all elements at
    once; an element ends when its next arrival is later than every register of its document (early termination).
    """
    first = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, np.uint64)
    time = np.zeros(len(marks))
    seed = marks.copy()
    while len(marks):
        seed = seed + _STEP
        draw = mix(seed)
        time = time - np.log(uniform(draw)) / weights
        last = first.reshape(n_docs, registers).max(axis=1)
        alive = time < last[doc]
        marks, weights, doc, seed, time, draw = (x[alive] for x in (marks, weights, doc, seed, time, draw))
        slot = doc * registers + (mix(draw ^ _STEP) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        owner[slot[won]] = marks[won]
    return owner.reshape(n_docs, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(n_docs, bands) keys: rows of a band and its number."""
    rows = signature.reshape(len(signature), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(rows.shape[2]):
        out = mix(out * _STEP + rows[:, :, j])
    return out.view(np.int64)


def sketch(texts: list[str | None], bands: int = BANDS, rows: int = ROWS) -> tuple[list[bytes], list[np.ndarray | None], list[int], list[bytes | None]]:
    """Content keys, band keys, numbers and points of distinct shingles of a few documents; no bands and point without words."""
    contents, parts, who, sizes = [], [], [], [0] * len(texts)
    for i, t in enumerate(texts):
        keys = plain_word_keys(t)
        contents.append(content_key(t, keys))
        if len(keys):
            parts.append(distinct(keys))
            who.append(i)
            sizes[i] = len(parts[-1])
    found: list[np.ndarray | None] = [None] * len(texts)
    points: list[bytes | None] = [None] * len(texts)
    if parts:
        doc = np.repeat(np.arange(len(parts)), [len(m) for m in parts])
        sign = signatures(np.concatenate(parts), np.ones(len(doc)), doc, len(parts), bands * rows)
        for i, b in zip(who, band_keys(sign, bands), strict=True):
            found[i] = b
        for i, marks in zip(who, parts, strict=True):
            points[i] = point(marks)
    return contents, found, sizes, points
