"""Language-model scoring by deleted interpolation, with counts of the whole corpus.

1. Documents are read once into chunks of tokens, written to the shared folder.
2. Each chunk counts its distinct words and word pairs and deals them by key into buckets, a slice per chunk and bucket.
   Keys are spread by hash and stand once per chunk, so no bucket is hot.  A bucket adds its slices up and sends each
   chunk the corpus counts of its own keys, for core and development texts apart.
3. Core counts against development texts give the held-out table, a few thousand cells; expectation-maximisation over
   it yields the mixture weights of each context-frequency bucket.
4. Each chunk scores its documents with the counts of all learning texts.

Development texts are the learning texts of one more crc32 remainder.  Words and pairs are told apart by 64-bit keys.

Defined cases: a null text is an empty one, whose only token is the end; a null id is in no fold and learnt from;
repeated rows are texts of their own; without learning texts counts are zero and every weight stays even; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gram_counts as G
from . import interpolation as I
from .common import fold, stage

MODULUS, HELD_FOLD, DEV_FOLD = 7, 2, 5
#: Tokens of a chunk, and distinct keys a bucket is laid out for.
CHUNK_TOKENS, BUCKET_TOKENS = 1_000_000, 1_000_000


def chunks(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(chunk, ids, roles, lengths, vocabulary, places): a row holds about CHUNK_TOKENS tokens, or one longer document."""
    role = F.when(fold(doc, MODULUS) == HELD_FOLD, G.HELD).when(fold(doc, MODULUS) == DEV_FOLD, G.DEV).otherwise(G.CORE).alias("role")

    def flush(held: list) -> pd.DataFrame:
        tokens, lengths = np.concatenate([t for t, _, _, _ in held]), np.concatenate([n for _, n, _, _ in held])
        vocabulary, places = G.pack_tokens(tokens)
        ids = [i for _, _, x, _ in held for i in x]
        roles = np.concatenate([r for _, _, _, r in held])
        row = {"chunk": uuid.uuid4().hex, "ids": ids, "roles": roles, "lengths": lengths, "vocabulary": vocabulary, "places": places}
        return pd.DataFrame([row])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            texts, ids, roles = batch["text"].tolist(), [None if pd.isna(i) else int(i) for i in batch["doc"]], batch["role"].to_numpy()
            for a in range(0, len(texts), 200):
                tokens, lengths = G.read_texts(texts[a : a + 200])
                held.append((tokens, lengths, ids[a : a + 200], roles[a : a + 200]))
                size += len(tokens)
                if size >= CHUNK_TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    cols = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), role)
    return cols.mapInPandas(run, "chunk string, ids array<long>, roles array<int>, lengths array<long>, vocabulary binary, places binary")


def open_chunk(row: object) -> G.Chunk:
    return G.Chunk(G.unpack_tokens(row.vocabulary, row.places), np.asarray(row.lengths, np.int64), np.asarray(row.roles))


def slices(held: DataFrame, bits: int) -> DataFrame:
    """(bucket, chunk, keys, core, dev): the distinct keys of a chunk that fall into a bucket, with the chunk's counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                chunk = open_chunk(row)
                keys = chunk.keys
                core, dev = chunk.counts()
                cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
                cuts = [0, *cuts.tolist(), len(keys)]
                rows = [
                    (b, row.chunk, G.pack_sorted(keys[a:z]), G.pack(core[a:z]), G.pack(dev[a:z])) for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a
                ]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "core", "dev"])

    return held.mapInPandas(run, "bucket long, chunk string, keys binary, core binary, dev binary")


def added(parts: DataFrame) -> DataFrame:
    """Corpus counts of each slice's keys; on one row of a bucket its distinct learnt words and its word tokens."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = [G.unpack_sorted(k) for k in group["keys"]]
        merged, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([G.unpack(x, np.uint32) for x in group[c]]), len(merged)).astype(np.uint64) for c in ("core", "dev")]
        word = ((merged & np.uint64(1)) == 1) & (merged != I.start_key())
        both, cuts = sums[0] + sums[1], np.cumsum([len(k) for k in keys])[:-1]
        core, dev = (np.split(s[back], cuts) for s in sums)
        lead = np.arange(len(group)) == 0
        return pd.DataFrame(
            {
                "chunk": group["chunk"], "bucket": group["bucket"], "core": [G.pack(x) for x in core], "dev": [G.pack(x) for x in dev],
                "types": np.where(lead, np.count_nonzero(word & (both > 0)), 0), "tokens": np.where(lead, int(both[word].sum()), 0),
                "core_tokens": np.where(lead, int(sums[0][word].sum()), 0),
            }
        )

    return parts.groupBy("bucket").applyInPandas(run, "chunk string, bucket long, core binary, dev binary, types long, tokens long, core_tokens long")


def joined(held: DataFrame, counted: DataFrame, total: int, types: int) -> DataFrame:
    """Each chunk with the corpus counts of its keys in order, and its held-out table."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples())
        right = right.sort_values("bucket")
        core, dev = (np.concatenate([G.unpack(x, np.uint64) for x in right[c]]) for c in ("core", "dev"))
        chunk = open_chunk(row)
        cells = I.held_out_table(chunk, core, total, types, G.DEV)
        return pd.DataFrame([row._asdict() | {"counts": G.pack(core + dev), "cells": [c.tolist() for c in cells]}]).drop(columns="Index")

    kind = "chunk string, ids array<long>, roles array<int>, lengths array<long>, vocabulary binary, places binary, counts binary, cells array<array<long>>"
    return held.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInPandas(run, kind)


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    held = stage(chunks(docs, doc, text))
    tokens = held.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n))).first()[0] or 0
    bits = max(0, int(tokens // BUCKET_TOKENS).bit_length())
    counted = stage(added(slices(held, bits)))
    sums = counted.agg(*[F.sum(c).alias(c) for c in ("types", "tokens", "core_tokens")]).first()
    types, total, core_total = (int(sums[c] or 0) for c in ("types", "tokens", "core_tokens"))
    ready = stage(joined(held, counted.select("chunk", "bucket", "core", "dev"), core_total, types))
    cell = ready.select(F.explode("cells").alias("c")).groupBy(*[F.col("c")[i].alias(n) for i, n in enumerate(("b", "p", "w"))]).agg(F.sum(F.col("c")[3]).alias("n"))
    # Bounded: buckets x steps of two logarithms.
    table = np.array([tuple(r) for r in cell.collect()], np.int64).reshape(-1, 4)
    weights = I.fit_weights(table[np.lexsort(table[:, :3].T)], types)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                chunk = open_chunk(row)
                found = I.score(chunk, G.unpack(row.counts, np.uint64), total, types, weights)
                yield pd.DataFrame({doc: pd.array(list(row.ids), "Int64"), "held_out": chunk.roles == G.HELD, **found, "train_tokens": total})

    kind = f"{doc} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    order = ("chunk", "ids", "roles", "lengths", "vocabulary", "places", "counts")
    return ready.select(*order).mapInPandas(run, kind)
