"""Deleted interpolation of word-pair, word and uniform estimates (numpy, inside tasks and on the driver)."""

from __future__ import annotations

import numpy as np

from .gram_counts import START, Chunk

#: Context-frequency buckets: powers of two; steps of the natural logarithm into which estimates are rounded for fitting.
BUCKETS, STEP, LEAST = 20, 0.1, -60.0


def bucket_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1.0).astype(np.int64), BUCKETS - 1)


def estimates(chunk: Chunk, counts: np.ndarray, total: int, types: int, mine: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Context bucket, pair and word estimates of the tokens ``mine``, and the uniform estimate."""
    word, pair, context = (counts[at[mine]].astype(float) for at in (chunk.word_at, chunk.pair_at, chunk.before_at))
    by_pair = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
    return bucket_of(context), by_pair, word / max(total, 1), 1.0 / (types + 1.0)


def rounded(p: np.ndarray) -> np.ndarray:
    """Logarithm in steps; 1 for an estimate of zero."""
    return np.where(p > 0, np.round(np.log(np.maximum(p, 1e-300)) / STEP), 1).astype(np.int64)


def held_out_table(chunk: Chunk, core: np.ndarray, total: int, types: int, role: int) -> np.ndarray:
    """(bucket, pair step, word step, tokens) of the development tokens under core counts."""
    bucket, by_pair, by_word, _ = estimates(chunk, core, total, types, chunk.role == role)
    rows = np.column_stack([bucket, rounded(by_pair), rounded(by_word)])
    found, n = np.unique(rows, axis=0, return_counts=True)
    return np.column_stack([found, n])


def fit_weights(table: np.ndarray, types: int, steps: int = 200) -> np.ndarray:
    """(BUCKETS, 3) weights of pair, word and uniform estimates by expectation-maximisation on held-out counts.

    Every weight starts with one token's worth of a third, so a bucket without held-out tokens keeps even weights and
    no weight becomes zero.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(table):
        return weights
    bucket, n = table[:, 0], table[:, 3].astype(float)
    p = np.column_stack([np.where(table[:, i] == 1, 0.0, np.exp(table[:, i] * STEP)) for i in (1, 2)] + [np.full(len(table), 1.0 / (types + 1.0))])
    for _ in range(steps):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        new = np.full((BUCKETS, 3), 1 / 3)
        np.add.at(new, bucket, share)
        new /= new.sum(axis=1, keepdims=True)
        done = np.max(np.abs(new - weights)) < 1e-7
        weights = new
        if done:
            break
    return weights


def score(chunk: Chunk, counts: np.ndarray, total: int, types: int, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Per document: tokens, known tokens, add-one and interpolated log10 probabilities."""
    bucket, by_pair, by_word, uniform = estimates(chunk, counts, total, types)
    mixed = weights[bucket, 0] * by_pair + weights[bucket, 1] * by_word + weights[bucket, 2] * uniform
    word = counts[chunk.word_at].astype(float)
    base = np.log10((word + 1.0) / (total + types + 1.0))
    add = lambda v: np.add.reduceat(v, chunk.firsts)
    return {"n_tokens": chunk.lengths, "n_known": add((word > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(mixed))}


def start_key() -> np.uint64:
    return START | np.uint64(1)
