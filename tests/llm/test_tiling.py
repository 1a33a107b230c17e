import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tideline.llm import string_tiling, tiling
from tideline.llm.textkit import plain_words


def naive_cover(text, item, min_match):
    """Words of the item under greedy tiles, all starts tried again after each tile."""
    used_t, used_i, covered = [False] * len(text), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and not used_t[p + n] and not used_i[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < min_match:
            return covered
        covered += n
        used_t[p : p + n] = [True] * n
        used_i[q : q + n] = [True] * n


@given(st.lists(st.sampled_from("abc"), min_size=3, max_size=40), st.lists(st.sampled_from("abc"), min_size=3, max_size=20))
@settings(max_examples=200, deadline=None)
def test_cover_matches_naive_tiling(text, item):
    found = tiling.TestItems([(7, " ".join(item))], 3).matches(" ".join(text), 0.0)
    assert round(sum(m[1] for m in found) * len(item)) == naive_cover(text, item, 3)


def test_reordered_passage_is_caught_and_clean_text_is_not(spark):
    pick = random.Random(2)
    words = [f"v{i}" for i in range(400)]
    item = [pick.choice(words) for _ in range(40)]
    turned = item[24:] + ["x"] * 9 + item[8:16] + ["y"] + item[:8]
    docs = [(1, " ".join(turned)), (2, " ".join(pick.choice(words) for _ in range(3000))), (3, " ".join(item[:12])), (4, "Intro. " + ", ".join(item).upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (8, "other words that stand nowhere else")], "item_id long, text string")
    for chars in (4_000_000, 50):  # one block, and several
        out = {r["doc_id"]: r for r in string_tiling.contamination(df, bench, block_chars=chars).collect()}
        assert {i for i, r in out.items() if r["contaminated"]} == {1, 4}
        assert out[1]["matches"][0]["item_id"] == 9 and out[1]["matches"][0]["tiles"] == 3 and out[4]["matches"][0]["coverage"] == 1.0


def test_given_documents_match_whole_passages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [" ".join(plain_words(r["text"])) for r in bench.collect()]
    out = string_tiling.contamination(docs.select("doc_id", "text"), bench).collect()
    planted = {r["doc_id"] for r in docs.collect() if any(x in " ".join(plain_words(r["text"])) for x in items)}
    assert planted and planted == {r["doc_id"] for r in out if r["contaminated"]}


def test_edges(spark):
    docs = cases.documents(spark).withColumnRenamed("score", "matches").withColumnRenamed("kept", "contaminated")
    out = string_tiling.contamination(docs, cases.benchmark(spark)).collect()
    assert len(out) == len(cases.TEXTS)
    assert {r["doc_id"] for r in out if r["contaminated"]} == {1, 2}
    none = cases.benchmark(spark).limit(0)
    assert not any(r["contaminated"] for r in string_tiling.contamination(docs, none).collect())
    assert string_tiling.contamination(cases.empty(spark), cases.benchmark(spark)).count() == 0
