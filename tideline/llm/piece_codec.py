"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field: pieces with scores and types, trainer and normaliser settings.  From it a
``Tokenizer`` is rebuilt: character map, white-space rules and the metaspace marker as normalisers, unigram scores as a
Unigram model or piece scores as merge ranks of a BPE model, byte pieces as byte fallback.  Batches are encoded by a
thread pool, decoded again, and held against the sentencepiece library piece by piece.

A model whose pieces never carry the marker behind another character splits at the marker without changing any result,
so repeated words are looked up instead of merged again.

Defined cases: a null text is an empty one, which has no ids and decodes to ""; texts of any length are encoded whole, in
batches bounded by characters; ``parity`` tells whether the ids equal sentencepiece's, and if they do not, the ids of
sentencepiece are returned; ``round_trip`` tells whether decoding gives the text back; repeated rows get equal results;
other input columns pass through untouched.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of one encoded batch, and threads of a task.
BATCH_CHARS = 400_000
THREADS = 2
#: A model file is a vocabulary; a larger one is not sent along.
MODEL_BYTES = 64 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"unexpected wire type {kind}")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """pieces [(piece, score, type)], and the settings that change results."""
    out: dict = {"pieces": [], "kind": 1, "byte_fallback": False, "unk": 0, "charsmap": b"", "dummy_prefix": True, "strip": True, "escape": True, "suffix": False}
    for field, value in _fields(data):
        if field == 1:
            x = dict(_fields(value))
            out["pieces"].append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
        elif field == 2:
            x = dict(_fields(value))
            out |= {"kind": x.get(3, 1), "byte_fallback": bool(x.get(35, 0)), "unk": x.get(40, 0), "suffix": bool(x.get(24, 0))}
        elif field == 3:
            x = dict(_fields(value))
            out |= {"charsmap": x.get(2, b""), "dummy_prefix": bool(x.get(3, 1)), "strip": bool(x.get(4, 1)), "escape": bool(x.get(5, 1))}
    if out["kind"] not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    if out["suffix"]:
        raise ValueError("models that treat white space as a suffix are not supported")
    return out


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Merge list of a BPE model: the pairs that make a piece, best score first."""
    own = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
    pairs = [(-score, i, (p[:i], p[i:])) for p, score in own.items() for i in range(1, len(p)) if p[:i] in own and p[i:] in own]
    return [pair for _, _, pair in sorted(pairs)]


def build_tokenizer(model: dict, cache: int = 10_000):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model["pieces"]
    unknown = pieces[model["unk"]][0]
    if model["kind"] == 1:
        core = models.Unigram([(p, s) for p, s, _ in pieces], model["unk"], byte_fallback=model["byte_fallback"])
    else:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(pieces)}, merges(pieces), unk_token=unknown, fuse_unk=True, byte_fallback=model["byte_fallback"], cache_capacity=cache
        )
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["strip"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if all(MARK not in p.lstrip(MARK) for p, _, kind in pieces if kind in (NORMAL, USER)):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    end = [decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    return tok


class Codec:
    """Encoder and decoder of one model, with the sentencepiece library beside it.

    Where no piece crosses the marker, a text is the chain of its segments (markers and what follows them), so each
    distinct segment is encoded, verified and decoded once; else whole texts are.
    """

    def __init__(self, data: bytes, threads: int = THREADS, remember: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import decoders, normalizers

        self.model, self.threads, self.limit = parse_model(data), threads, remember
        self.tokenizer, self.pieces = build_tokenizer(self.model), build_tokenizer(self.model, 0)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.splits = self.tokenizer.pre_tokenizer is not None
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.plain = not self.model["charsmap"] and not self.model["strip"] and self.model["escape"] and self.model["dummy_prefix"]
        self.opens = np.array([p[:1] == MARK for p, _, _ in self.model["pieces"]])
        #: Ids of the segments met so far, packed; decoded text and parity of those that do not decode to themselves.
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, tuple[str, bool]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Whole texts through the rebuilt tokenizer."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def _learn(self, segments: list[str]) -> None:
        """Encode, verify and decode new segments; those with one marker in front go in long chains."""
        chained = [s for s in segments if len(s) > 1 and s[0] == MARK and s[1] != MARK]
        groups = [chained[i : i + 2000] for i in range(0, len(chained), 2000)]
        one_by_one = [s for s in segments if not (len(s) > 1 and s[0] == MARK and s[1] != MARK)]
        texts = ["".join(g) for g in groups]
        own, theirs = self._both(texts)
        for group, ids, expected, decoded in zip(groups, own, theirs, self.pieces.decode_batch(theirs, skip_special_tokens=False), strict=True):
            flat = np.array(expected, np.int32)
            starts = np.flatnonzero(self.opens[flat])
            if ids != expected or len(starts) != len(group) or decoded != "".join(group).replace(MARK, " "):
                one_by_one += group
                continue
            packed, cuts = flat.tobytes(), [*(starts * 4).tolist(), len(flat) * 4]
            self.known.update((s, packed[a:z]) for s, a, z in zip(group, cuts, cuts[1:], strict=False))
        own, theirs = self._both(one_by_one)
        decoded = self.pieces.decode_batch(theirs, skip_special_tokens=False)
        for s, i, e, d in zip(one_by_one, own, theirs, decoded, strict=True):
            self.known[s] = np.array(e, np.int32).tobytes()
            if i != e or d != s.replace(MARK, " "):
                self.odd[s] = (d, i == e)

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of marked texts by either library."""
        own = [e.ids for e in self.pieces.encode_batch_fast(texts, add_special_tokens=False)]
        # The library puts the first marker in front by itself, but not before an empty text.
        raw = [t[1:] if self.model["dummy_prefix"] else t for t in texts]
        theirs = self.reference.encode(raw, num_threads=self.threads)
        return own, [e if r or t != MARK else [self.reference.piece_to_id(MARK)] for e, r, t in zip(theirs, raw, texts, strict=True)]

    def convert(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, bool]]:
        """(ids, decoded text, parity) of each text; the ids are those of sentencepiece if the two differ."""
        if not self.splits:
            ids, expected = self.encode(texts), self.reference.encode(texts, num_threads=self.threads)
            yield from zip([np.array(e, np.int32) for e in expected], self.decode(expected), [a == b for a, b in zip(ids, expected, strict=True)], strict=True)
            return
        if self.plain:
            normal = [(MARK + t).replace(" ", MARK) if t else "" for t in texts]
        else:
            normal = [self.tokenizer.normalizer.normalize_str(t) for t in texts]
        chains = [_SEGMENT.findall(t) for t in normal]
        fresh = set().union(*chains).difference(self.known)
        if len(self.known) + len(fresh) > self.limit:
            self.known.clear()
            self.odd.clear()
            fresh = set().union(*chains)
        if fresh:
            self._learn(list(fresh))
        for chain, text in zip(chains, normal, strict=True):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, chain)), np.int32)
            parity, text = True, text.replace(MARK, " ")
            if self.odd and not self.odd.keys().isdisjoint(chain):
                found = [self.odd.get(s) or (s.replace(MARK, " "), True) for s in chain]
                text, parity = "".join([d for d, _ in found]), all(p for _, p in found)
            yield ids, text[1:] if self.model["dummy_prefix"] and text[:1] == " " else text, parity


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return data


RESULT = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "round_trip": T.BooleanType(), "parity": T.BooleanType()}


def code(docs: DataFrame, model_path: str, text: str = "text", results: tuple[str, ...] = tuple(RESULT)) -> DataFrame:
    """Adds the chosen results to ``docs``; an input column of the same name gives way."""
    docs = docs.drop(*[c for c in results if c != text])
    data = model_bytes(model_path)  # on the driver; tasks get the bytes, not the path
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, RESULT[c]) for c in results)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size < BATCH_CHARS and i + 1 < len(texts):
                    continue
                part, start, first, size = [t or "" for t in texts[start : i + 1]], i + 1, start, 0
                ids, decoded, parity = zip(*codec.convert(part), strict=True)
                lengths = np.fromiter(map(len, ids), np.int32, len(ids))
                offsets = pa.array(np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)]))
                flat = pa.array(np.concatenate(ids))
                made = {
                    "n_tokens": pa.array(lengths.astype(np.int64)), "ids": pa.ListArray.from_arrays(offsets, flat), "decoded": pa.array(decoded, pa.string()),
                    "round_trip": pa.array([a == b for a, b in zip(part, decoded, strict=True)]), "parity": pa.array(parity, pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays([*batch.slice(first, i + 1 - first).columns, *(made[c] for c in results)], [*batch.schema.names, *results])

    return docs.mapInArrow(run, schema)
