import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm import cases
from tideline.llm import count_tree, meeting_cells, ngram_join

RUN = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = RUN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(docs):
    """[(id, size, component)] by all pairs that share a shingle."""
    sets, parent, by = [shingle_set(t) for _, t in docs], list(range(len(docs))), defaultdict(set)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x]}:
            if 100 * len(s & sets[j]) >= 90 * len(s | sets[j]):
                parent[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            first[root(i)] = min(d, first.get(root(i), d))
    return sorted(((d, len(sets[i]), first.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=repr)


def found(spark, docs):
    out = ngram_join.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def crowd(n=150):
    """Near copies around a base on both sides of the limit, a chain, copies, unrelated texts, some of very common words."""
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(5))
    docs, base = [], [word() for _ in range(180)]
    for i in range(n):
        said = list(base)
        for _ in range(pick.randrange(0, 6)):
            said[pick.randrange(180)] = word()
        docs.append((i, " ".join(said)))
    chain = [word() for _ in range(150)]
    for i in range(n, n + 25):
        chain[(i * 7) % 150] = word()
        docs.append((i, " ".join(chain[: 150 - (i - n)])))
    docs += [(i, "Same, copy TEXT for everyone! " * 3) for i in range(n + 30, n + 60)]
    docs += [(i, "a b") for i in range(n + 60, n + 64)] + [(n + 64, "b a"), (n + 65, "a b c")]
    docs += [(i, " ".join(pick.choice(["a", "b", "c"]) for _ in range(pick.randrange(1, 80)))) for i in range(n + 70, n + 140)]
    pick.shuffle(docs)
    return docs


def test_components_match_brute_force(spark):
    docs = crowd()
    expected = brute(docs)
    assert len({c for *_, c in expected}) > 30
    assert found(spark, docs) == expected


def test_cells_of_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(meeting_cells, "BLOCK_ROWS", 12)
    monkeypatch.setattr(meeting_cells, "BLOCK_MARKS", 900)
    # Whatever the order of the shingles.
    monkeypatch.setattr(ngram_join, "_counter", lambda marks: np.zeros(len(marks), np.int64))
    docs = crowd(90)
    assert found(spark, docs) == brute(docs)


def test_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, docs) == brute(docs)


def test_bound_holds_and_counts_of_any_size_are_kept():
    pick = np.random.default_rng(2)
    for n in (5, 300, 200_000):
        a = np.unique(pick.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], pick.integers(0, 2**63, n).astype(np.uint64)]))
        x = count_tree.unpacked([count_tree.point(a), count_tree.point(b)]).astype(np.int64)
        assert x.sum(axis=1).tolist() == [len(a), len(b)]
        assert np.minimum(*x).sum() >= len(np.intersect1d(a, b))


def test_tree_compares_few_pairs_of_a_crowd():
    """A hundred-fold group of near copies needs a number of comparisons in proportion to it."""
    pick = np.random.default_rng(4)
    base, tried = pick.integers(0, 2**63, 400).astype(np.uint64), []
    sets = []
    for _ in range(1000):
        s = base.copy()
        s[pick.integers(0, 400, 4)] = pick.integers(0, 2**63, 4).astype(np.uint64)
        sets.append(np.unique(s))
    counts = count_tree.unpacked([count_tree.point(s) for s in sets])

    def linked(i, j):
        tried.append((i, j))
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both)

    assert len(count_tree.spanning_links(np.array([len(s) for s in sets]), counts, 90, linked)) == 999
    assert len(tried) < 1100


def test_edges(spark):
    docs = cases.documents(spark).withColumn("set", F.lit(1)).withColumn("row", F.lit(2)).withColumn("size", F.lit(3)).withColumn("component_id", F.lit(4))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r) for r in ngram_join.similar(docs).collect()), key=repr)
    assert got == brute(rows)
    assert ngram_join.similar(cases.empty(spark)).count() == 0
    only = spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.similar(only).collect()), key=repr) == sorted([(1, 0, 1), (2, 0, 2), (None, 0, None)], key=repr)
