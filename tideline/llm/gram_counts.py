"""Word and word-pair keys of chunks of documents, packed for the shuffle (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import zstandard

from .textkit import lowered_run_keys, mix

#: Tokens that no text contains: before the first word and after the last.
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
CORE, DEV, HELD = 0, 1, 2


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes: the high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.zeros(1, x.dtype)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


class Chunk:
    """Tokens of some documents: word keys in order, an end after each text."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, roles: np.ndarray) -> None:
        self.tokens, self.lengths, self.roles = tokens, lengths, roles
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        firsts = np.cumsum(lengths) - lengths
        before[firsts] = START
        # Odd keys are words, even keys are pairs.
        word, pair = tokens | np.uint64(1), mix(mix(before) * _PAIR + tokens) & ~np.uint64(1)
        self.role, self.firsts = np.repeat(roles, lengths), firsts
        #: Distinct keys in order, and the place of each token's word, pair and context among them.
        self.keys, place = np.unique(np.concatenate([word, pair, np.array([START | np.uint64(1)])]), return_inverse=True)
        self.word_at, self.pair_at, self.start_at = place[: len(tokens)], place[len(tokens) : -1], int(place[-1])
        self.before_at = np.empty_like(self.word_at)
        self.before_at[1:] = self.word_at[:-1]
        self.before_at[firsts] = self.start_at

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each key stands in core and in development texts; the start counts once a text."""
        out = []
        for role in (CORE, DEV):
            mine = self.role == role
            n = np.bincount(self.word_at[mine], minlength=len(self.keys)) + np.bincount(self.pair_at[mine], minlength=len(self.keys))
            n[self.start_at] += np.count_nonzero(self.roles == role)
            out.append(n.astype(np.uint32))
        return out[0], out[1]


def read_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts one after the other, and how many each has, the end included."""
    parts, lengths = [], []
    for t in texts:
        keys = lowered_run_keys(t or "")
        parts += (keys, np.array([END]))
        lengths.append(len(keys) + 1)
    return np.concatenate(parts), np.array(lengths, np.int64)


def pack_tokens(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """Vocabulary, most frequent word first, and the tokens as places in it."""
    words, back, times = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(words[order].tobytes()), pack(rank[back])


def unpack_tokens(vocabulary: bytes, places: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(vocabulary), np.uint64)[unpack(places, np.uint32)]
