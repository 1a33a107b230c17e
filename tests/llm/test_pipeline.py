import corpus_pipeline
from tests.llm import cases, test_lines, test_near, test_tiling
from tideline.llm import nearest_votes, piece_codec
from tideline.llm.queries_format import PIECE_MODEL
from tideline.llm.textkit import plain_words

FOLDER = "/root/testdata/sf0.01"


def leaks(words, items):
    grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    near = [x for x in items if any(tuple(x[i : i + 5]) in grams for i in range(len(x) - 4))]
    return any(test_tiling.naive_cover(words, x, 5) >= 0.5 * len(x) for x in near)


def test_run_matches_stage_by_stage_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = nearest_votes.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    clean = sorted(i for i, r in rows.items() if model.score(r["text"])[0] < nearest_votes.THRESHOLD)
    assert len(clean) < len(rows)
    texts = test_lines.brute([(i, rows[i]["text"]) for i in clean])
    classes = test_near.brute_classes(sorted(texts.items()))
    left = {i: texts[i] for i in texts if classes[i] == i}
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not leaks(plain_words(t), items)}
    library = piece_codec.Codec(piece_codec.model_bytes(PIECE_MODEL)).reference
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert out.keys() == left.keys()
    for i, r in out.items():
        assert r["text"] == left[i] and r["n_chars"] == len(left[i]) and r["ids"] == library.encode(left[i]) and r["round_trip"] and r["parity"]
        assert (r["lang"], r["source"]) == (rows[i]["lang"], rows[i]["source"])


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    cases.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    cases.benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "piece_encoding"]
    for docs in (cases.documents(spark), cases.empty(spark)):
        for name, step in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{docs.count() > 0}")
            out = step(spark, docs, str(tmp_path))
            if name != "piece_encoding":
                assert out.dtypes == docs.dtypes
            out.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
