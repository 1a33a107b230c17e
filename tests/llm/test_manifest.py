import hashlib
import zlib

from pyspark.sql import functions as F

from tests.llm import cases
from tideline.llm import merkle_manifest as mm
from tideline.llm.queries_manifest import TAMPERED


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(digests):
    """Top, and per leaf its siblings (before, after) level by level."""
    paths, nodes, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p - p % 8
            paths[i].append((nodes[run:p], nodes[p + 1 : run + 8]))
            at[i] = p // 8
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows, changed):
    """{(id, leaf): (subroot, root, proof, folded root)}; rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, inner = [], {}
    for g in names:
        held = sorted(groups[g], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        top, paths = climb([d for _, d in held])
        tops.append(top)
        inner[g] = list(zip(held, paths))
    root, upper = climb(tops)
    out = []
    for g, top, crown in zip(names, tops, upper):
        for (r, d), path in inner[g]:
            path = path + crown
            node = leaf(changed(r))
            for before, after in path:
                node = h(*before, node, *after)
            out.append((r[0], d, top, root, h(*[x for b, a in path for x in b + a]), node))
    return sorted(out, key=repr)


def tampered(row):
    i, text = row[0], row[4]
    if i is None or text is None or zlib.crc32(str(i).encode()) % TAMPERED:
        return row
    return (*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def run(df):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    out = mm.manifest(df, changed={"text": F.when(hit, mm.lower_ascii(F.col("text"))).otherwise(F.col("text"))})
    got = out.select("doc_id", "leaf", "subroot", "root", mm.proof_digest(F.col("path")), mm.folded(F.col("checked_leaf"), F.col("path")))
    return sorted((tuple(r) for r in got.collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_trees_of_all_shapes_match_brute_force(spark):
    rows, i = [], 0
    for lang, n in (("one", 1), ("eight", 8), ("nine", 9), ("full", 64), ("more", 73), (None, 5), ("", 2), ("é", 3), ("Z", 65)):
        for k in range(n):
            i += 1
            rows.append((i * 7 % 1009, None if k % 4 == 1 else "web", lang, None if k % 5 == 2 else k, None if k % 6 == 3 else f"Text É {k % 3} of {lang}"))
    rows += rows[:3]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = run(df)
    assert found == brute(rows, tampered)
    kept = [r[5] == r[3] for r in found]
    assert any(kept) and not all(kept)


def test_levels_beyond_a_window_block(spark, monkeypatch):
    monkeypatch.setattr(mm, "BLOCK", 8)
    rows = [(k, "s", "en", k, f"A {k}") for k in range(700)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows, tampered)


def test_edges(spark):
    docs = cases.documents(spark).withColumn("_digest", F.lit("x")).withColumn("root", F.lit(1)).withColumn("_group", F.lit(2))
    rows = [tuple(r) for r in docs.select(*mm.FIELDS).collect()]
    assert run(docs) == brute(rows, tampered)
    out = mm.manifest(cases.empty(spark))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "leaf", "checked_leaf", "subroot", "root", "path"]
