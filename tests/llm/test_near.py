import random
import re
from collections import defaultdict

import numpy as np

from tests.llm import cases
from tideline.llm import prob_minhash as P
from tideline.llm import prob_sketch as S
from tideline.llm.textkit import plain_word_keys


def shingle_set(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(docs):
    """{id: least id of the class} by all pairs."""
    sets, parent = {i: shingle_set(t) for i, t in docs}, {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    text, by = dict(docs), defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for i, s in sets.items():
        if not s:
            near = [j for j in sets if not sets[j] and (text[i] or "") == (text[j] or "")]
        else:
            near = [j for j in {j for x in s for j in by[x]} if len(s & sets[j]) >= 0.8 * len(s | sets[j])]
        for j in near:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def crowd():
    """Near copies in a chain and around a base, exact copies, and unrelated texts."""
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(5))
    docs, base = [], [word() for _ in range(200)]
    for i in range(40):
        said = list(base)
        said[pick.randrange(200)] = word()
        docs.append((i, " ".join(said)))
    chain = [word() for _ in range(150)]
    for i in range(40, 60):
        chain[(i * 7) % 150] = word()
        docs.append((i, " ".join(chain)))
    docs += [(i, "Same, copy text for everyone! " * 3) for i in range(60, 90)]
    docs += [(i, " ".join(word() for _ in range(pick.randrange(1, 80)))) for i in range(90, 130)]
    return docs


def test_classes_match_brute_force(spark):
    docs = crowd()
    out = P.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute_classes(docs)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)


def test_classes_of_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    out = P.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute_classes(docs)


def test_near_copies_with_a_repeated_block(spark):
    """How often a text repeats a passage does not count in the set Jaccard, so it must not hide a pair from the bands."""
    pick = random.Random(8)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    docs = []
    for i in range(0, 48, 2):
        block, rest = [word() for _ in range(20)], [word() for _ in range(80)]
        changed = [*rest[:40], word(), *rest[41:]] if i % 4 else rest
        docs += [(i, " ".join(block * 2 + rest)), (i + 1, " ".join(block * 1000 + changed))]
    out = P.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert brute_classes(docs) == {i: i - i % 2 for i, _ in docs}
    assert {r["doc_id"]: r["class_id"] for r in out} == brute_classes(docs)


def test_registers_estimate_probability_jaccard():
    keys = plain_word_keys(" ".join(f"w{i}" for i in range(3000)))
    pick = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        a = {int(k): float(w) for k, w in zip(keys[:1000], pick.uniform(0.5, 3, 1000))}
        b = {int(k): float(w) for k, w in zip(keys[int(1000 * (1 - share)) :][:1000], pick.uniform(0.5, 3, 1000))}
        exact = 0.0
        for k in a.keys() & b.keys():
            every = a.keys() | b.keys()
            exact += 1.0 / sum(max(a.get(x, 0.0) / a[k], b.get(x, 0.0) / b[k]) for x in every)
        doc = np.repeat([0, 1], [len(a), len(b)])
        sign = S.signatures(np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), doc, 2, 2000)
        assert abs(np.mean(sign[0] == sign[1]) - exact) < 0.05


def test_edges(spark):
    docs = cases.documents(spark).withColumnRenamed("n", "row").withColumnRenamed("score", "class_id").withColumnRenamed("label", "content")
    out = P.near_duplicates(docs).collect()
    assert len(out) == len(cases.TEXTS)
    by = {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None}
    assert by[1] == by[2] == 1 and by[8] == by[9] == 8 and by[3] == by[4] == 3 and by[6] == 6 and by[5] == 5
    kept = P.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 5, 6, 7, 8, 10, 11]
    assert P.near_duplicates(cases.empty(spark)).count() == 0 and P.keep_one(cases.empty(spark)).count() == 0


def test_repeated_row_is_kept_once(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in P.keep_one(df).collect()) == [(1, "a b c"), (3, "z")]
