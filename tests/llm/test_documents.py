import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from tideline.llm import additive_pairs, deleted_interpolation, divergence, gam, nearest_votes, queries_documents, vote_index
from tideline.llm import interpolation as I

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_row(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def test_divergence_base_columns_and_verdict(spark, texts):
    rows = queries_documents.op4_quality_divergence(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_row(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    known = [(quality[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in quality and r["n_words"] >= 20]
    assert np.mean([bool(q) == k for q, k in known]) > 0.9


def test_distances_match_the_definition():
    rows = [("x", "class", 0, 60), ("x", "class", 3, 40), ("x", "total", 0, 10), ("x", "word", int(np.int64(5)), 4)]
    refs = divergence.References(rows)
    p, q = np.array([3, 0, 0, 1]) / 4, np.array([60, 0, 0, 40]) / 100
    m = (p + q) / 2
    entropy = lambda a: -sum(x * math.log2(x) for x in a if x)
    found = divergence.distances(np.array([3, 0, 0, 1, 0, 0, 0, 0, 0, 0]) / 4, refs.char_refs, refs.char_info)
    assert abs(found[0] - math.sqrt(entropy(m) - (entropy(p) + entropy(q)) / 2)) < 1e-9


def test_language_model_counts_and_base_score(spark, texts):
    rows = queries_documents.op6_deleted_interpolation(spark, FOLDER).collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*WORD.findall(t.translate(lower)), None] for i, t in texts.items()}
    remainder = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}
    count = Counter(x for i, t in tokens.items() if remainder[i] != 2 for x in t)
    pairs = Counter(p for i, t in tokens.items() if remainder[i] != 2 for p in zip(["<"] + t, t))
    context = Counter(a for (a, _), n in pairs.items() for _ in range(n))
    total, types = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    scores = {}
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(x in count for x in t), total, remainder[r["doc_id"]] == 2)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (total + types + 1)) for x in t), rel_tol=1e-9)
        scores[r["doc_id"]] = r["score"]
    held = [i for i in texts if remainder[i] == 2]
    better = sum(scores[i] for i in held) / sum(r["base_score"] for r in rows if r["held_out"])
    assert better < 1.0  # log probabilities: the mixture beats add-one on texts it has not seen
    # The weights behind the scores, from the development texts by plain expectation-maximisation.
    core = Counter(x for i, t in tokens.items() if remainder[i] not in (2, 5) for x in t)
    core_pairs = Counter(p for i, t in tokens.items() if remainder[i] not in (2, 5) for p in zip(["<"] + t, t))
    core_context = Counter()
    for (a, _), n in core_pairs.items():
        core_context[a] += n
    seen = [
        (I.bucket_of(np.array([core_context[a]]))[0], core_pairs[a, x] / core_context[a] if core_context[a] else 0.0, core[x] / sum(core.values()), 1 / (types + 1))
        for i, t in tokens.items() if remainder[i] == 5 for a, x in zip(["<"] + t, t)
    ]
    weights = np.full((I.BUCKETS, 3), 1 / 3)
    bucket, p = np.array([s[0] for s in seen]), np.array([s[1:] for s in seen])
    for _ in range(200):
        share = weights[bucket] * p
        new = np.full((I.BUCKETS, 3), 1 / 3)
        np.add.at(new, bucket, share / share.sum(axis=1, keepdims=True))
        weights = new / new.sum(axis=1, keepdims=True)
    for i in list(texts)[:40]:
        t = tokens[i]
        mine = sum(
            math.log10(
                weights[min(int(math.log2(context[a] + 1)), I.BUCKETS - 1)]
                @ np.array([pairs[a, x] / context[a] if context[a] else 0.0, count[x] / total, 1 / (types + 1)])
            )
            for a, x in zip(["<"] + t, t)
        )
        assert math.isclose(mine, scores[i], rel_tol=0.01)


def test_language_model_mixture_is_a_distribution():
    weights = I.fit_weights(np.array([[2, -10, -30, 50], [2, 1, -40, 10], [3, 1, 1, 5]]), 100)
    assert np.allclose(weights.sum(axis=1), 1) and (weights > 0).all()


def test_language_model_edges(spark):
    out = deleted_interpolation.score_documents(cases.documents(spark)).collect()
    assert len(out) == len(cases.TEXTS) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (3, 4, 5)} == {1}
    assert sum(r["doc_id"] is None for r in out) == 2
    assert deleted_interpolation.score_documents(cases.empty(spark)).count() == 0


def test_nearest_is_exact():
    pick = np.random.default_rng(4)
    terms = np.sort(pick.integers(0, 2**63, 60).astype(np.uint64))
    vectors = []
    for i in range(900):
        which = np.sort(pick.choice(60, pick.integers(1, 6), replace=False))
        w = pick.uniform(0.2, 2, len(which))
        vectors.append((which, w / np.linalg.norm(w), float(i % 2), float(1 - i % 2), i))
    index = vote_index.VoteIndex(len(terms), vectors)
    dense = np.zeros((len(vectors), 60))
    for row, v in zip(dense, index.vectors):
        row[v[0]] = v[1]
    for _ in range(100):
        which = np.sort(pick.choice(60, pick.integers(1, 8), replace=False))
        w = pick.uniform(0.2, 2, len(which))
        query = np.zeros(60)
        query[which] = w
        at, cosine = index.nearest(which, w, 15)
        want = np.sort((dense @ query)[dense @ query > 0])[::-1][:15]
        assert np.allclose(cosine, want) and np.allclose(dense[at] @ query, cosine)


def test_index_of_counts_is_small_and_agrees_with_weights():
    pick = np.random.default_rng(7)
    idf = pick.uniform(1, 9, 400)
    counted = []
    for i in range(500):
        which = np.sort(pick.choice(400, pick.integers(1, 20), replace=False))
        counted.append((which, pick.integers(1, 300, len(which)).astype(np.uint16), float(i % 2), float(1 - i % 2), i))
    index = vote_index.VoteIndex(400, counted, idf)
    assert index.who.itemsize + index.entry.itemsize == 4  # bytes of a posting
    dense = np.zeros((500, 400))
    for row, (which, times, *_) in zip(dense, counted):
        row[which] = vote_index.unit(which, times, idf)[1]
    texts = [vote_index.unit(w, n, idf) for w, n, *_ in counted[:: 2]]
    found = index.nearest_all(texts, 15)
    for (which, weight), (at, cosine) in zip(texts, found):
        cosines = dense[:, which] @ weight
        want = np.sort(cosines[cosines > 0])[::-1][:15]
        assert np.allclose(cosine, want, rtol=0, atol=1e-11) and np.allclose(cosines[at], cosine, rtol=0, atol=1e-11)
    # A text's cosines do not depend on the texts beside it.
    assert all(np.array_equal(index.nearest(*t)[1], c) for t, (_, c) in zip(texts, found))


def test_index_deals_like_vectors_into_groups():
    """Terms that are common among like vectors only are dense rows there, not postings; the neighbours stay exact."""
    pick = np.random.default_rng(11)
    idf = pick.uniform(1, 9, 5 * 60 + 40)
    counted = []
    for i in range(600):
        own = np.sort(np.concatenate([60 * (i % 5) + pick.choice(60, 20, replace=False), 300 + pick.choice(40, 1)]))
        counted.append((own, pick.integers(1, 5, len(own)).astype(np.uint16), float(i % 2), float(1 - i % 2), i))
    counted += [(c[0], c[1], 1.0, 0.0, 600 + n) for n, c in enumerate(counted[:40])]  # ties
    index = vote_index.VoteIndex(len(idf), counted, idf)
    assert len(index.who) < 0.2 * sum(len(c[0]) for c in counted)
    dense = np.zeros((len(counted), len(idf)))
    for row, (which, times, *_) in zip(dense, counted):
        row[which] = vote_index.unit(which, times, idf)[1]
    texts = [vote_index.unit(w, n, idf) for w, n, *_ in counted[::3]] + [(np.arange(len(idf)), np.full(len(idf), 0.01)), (np.array([7]), np.ones(1)), (np.empty(0, int), np.empty(0))]
    for (which, weight), (at, cosine) in zip(texts, index.nearest_all(texts, 15), strict=True):
        cosines = np.round(dense[:, which] @ weight, 9)
        want = sorted((-c, i) for i, c in enumerate(cosines) if c > 0)[:15]
        assert at.tolist() == [i for _, i in want] and np.allclose(cosine, [-c for c, _ in want], rtol=0, atol=2e-9)


def test_vectors_hold_all_terms_of_the_sample(spark):
    """Evidence is the exact cosine over every term of the labelled texts, of whichever label and however rare."""
    learnt = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 0][:12]
    said = [f"common words for all {'vile' if n % 3 == 0 else 'kind'} once{n} rare{n} pair{n // 2}" for n in range(12)]
    docs = spark.createDataFrame([*zip(learnt, said), (900, "once5 pair2"), (901, "nothing known")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n % 3 == 0)) for n, i in enumerate(learnt)], "doc_id long, toxic int")
    model = nearest_votes.fit(docs, labels)
    bags = [Counter(vote_index.features(t).tolist()) for t in said]
    idf = {k: 1 + math.log(13 / (1 + sum(k in b for b in bags))) for b in bags for k in b}
    assert set(model.terms.tolist()) == set(idf)

    def cosine(a, b):
        a, b = ({k: (1 + math.log(n)) * idf[k] for k, n in x.items() if k in idf} for x in (a, b))
        size = lambda v: math.sqrt(sum(w * w for w in v.values()))
        return sum(w * b.get(k, 0.0) for k, w in a.items()) / (size(a) * size(b))

    out = {r["doc_id"]: r["evidence"] for r in nearest_votes.score(docs, model).collect()}
    query = Counter(vote_index.features("once5 pair2").tolist())
    want = sorted(((cosine(query, b), -i) for i, b in zip(learnt, bags)), reverse=True)[:3]
    assert [e["doc_id"] for e in out[900]] == [-i for _, i in want] and np.allclose([e["cosine"] for e in out[900]], [c for c, _ in want])
    assert out[901] == [] and all(out[i][0]["doc_id"] == i and math.isclose(out[i][0]["cosine"], 1.0) for i in learnt)


@pytest.mark.parametrize(("query", "label", "least"), [("op9_nearest_votes", "toxic", 0.93), ("op8_additive_pairs", "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    folder = "/root/testdata/sf0.01"
    rows = getattr(queries_documents, query)(spark, folder).collect()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean(held) >= least


def test_scores_do_not_use_held_out_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) AS quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    for part, kind in ((nearest_votes, "toxic"), (additive_pairs, "quality")):
        one, two = ({(r["doc_id"], r["score"]) for r in part.score(docs, part.fit(docs, x, kind)).collect()} for x in (labels, turned))
        assert one == two


@pytest.mark.parametrize("part", [nearest_votes, additive_pairs])
def test_classifier_edges(spark, part):
    docs = cases.documents(spark)
    kind = "toxic" if part is nearest_votes else "quality"
    for labels in (cases.labels(spark), cases.labels(spark).limit(0)):
        out = part.score(docs, part.fit(docs, labels, kind)).collect()
        assert len(out) == len(cases.TEXTS) and all(0 <= r["score"] <= 1 for r in out)
    model = part.fit(cases.empty(spark), cases.labels(spark), kind)
    assert part.score(cases.empty(spark), model).count() == 0


def test_divergence_edges(spark):
    docs = cases.documents(spark).withColumnRenamed("score", "n_words").withColumnRenamed("n", "m")
    refs = [tuple(r) for r in divergence.references(docs).collect()]
    out = divergence.judge(docs, refs).collect()
    assert len(out) == len(cases.TEXTS)
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_row(r["text"])
    assert divergence.judge(cases.empty(spark), []).count() == 0
    assert [r["kept"] for r in divergence.judge(docs.where("doc_id = 8"), []).collect()] == [not base_row(cases.LONG)[-1]]


def test_additive_model_learns_an_interaction():
    pick = np.random.default_rng(0)
    x = pick.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) != (x[:, 2] > 0)).astype(float)
    model = gam.fit(x, y, np.ones(len(y)), rounds=30)
    test = pick.uniform(-1, 1, (1000, 4))
    assert (0, 2) in model.pairs
    assert np.mean((model.probability(test) > 0.5) == ((test[:, 0] > 0) != (test[:, 2] > 0))) > 0.9
