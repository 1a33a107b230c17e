import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm import cases
from tideline.llm import item_heaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    said = [(d, Counter(terms(t))) for d, t in docs]
    said = [(d, c) for d, c in said if c]
    n_docs, n_terms = len(said), sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in said:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def crowd():
    pick = random.Random(5)
    word = lambda: pick.choice(["Alpha", "beta", "GAMMA", "δelta", "日本", "x1", "und", "the", "THE", "é"]) + pick.choice(["", "", str(pick.randrange(30))])
    docs = [(i, pick.choice([" ", ", ", "-", "_"]).join(word() for _ in range(pick.randrange(0, 60)))) for i in range(300)]
    docs += [(i, "the the alpha 日本 tie") for i in range(300, 330)]
    items = [(i, " ".join(word() for _ in range(pick.randrange(0, 25)))) for i in range(40)]
    return docs, items


def test_ranks_match_brute_force(spark):
    docs, items = crowd()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert found(item_heaps.search(df, wanted)) == expected
    # Blocks of items of any size give the same.
    assert found(item_heaps.search(df, wanted, block_bytes=300)) == expected
    assert found(item_heaps.search(df, wanted, top=3)) == brute(docs, items, 3)


def test_equal_scores_go_by_id(spark):
    docs = [(i, "same words here") for i in range(50)] + [(None, "same words here")] + [(60, "other")] * 200
    got = found(item_heaps.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame([(1, "Same WORDS")], "item_id int, text string")))
    assert sorted(r[2] for r in got) == list(range(10)) and [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(10))


def test_edges(spark):
    docs = cases.documents(spark).withColumn("rank", F.lit(9)).withColumn("item_id", F.lit(8)).withColumn("terms", F.lit(7))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "two three"), (2, None), (None, "word w5x5"), (3, "!!"), (4, "TAIL tail"), (1, "two three"), (5, "日本語 end"), (6, cases.LONG)]
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("a"))
    assert found(item_heaps.search(docs, wanted)) == brute(rows, items)
    assert item_heaps.search(cases.empty(spark), wanted).count() == 0
    assert found(item_heaps.search(docs, wanted.where("item_id = 99"))) == []
