import random
import re
from collections import Counter, defaultdict

import duckdb

from tests.llm import cases
from tideline.llm import line_templates as L
from tideline.llm.line_templates_sql import LINE_SQL
from tideline.llm import queries_copies
from tools.check import canonical

FOLDER = "/root/testdata/sf0.001"


def brute(docs):
    """[(id, text)] -> {id: text without recurring lines}, ids distinct."""
    lines = {}
    for i, text in docs:
        for n, line in enumerate(text.split("\n")):
            parts = re.findall(r"[^\x20\x09-\x0D]+", line)
            if parts:
                lines[i, n] = tuple(L.FIELD if re.search("[0-9]", p) else p for p in parts)
    leaves = defaultdict(set)
    for parts in lines.values():
        if len(parts) >= L.MIN_TOKENS:
            leaves[len(parts), parts[: L.DEPTH]].add(parts)
    template = {}
    for leaf, members in leaves.items():
        if len(members) < 2:
            continue
        const = {}
        for at in range(L.DEPTH, leaf[0]):
            n, token = max((n, t) for t, n in Counter(m[at] for m in members).items())
            if 2 * n >= len(members) and n >= 2:
                const[at] = token
        for m in members:
            if sum(m[at] == t for at, t in const.items()) >= L.AGREEMENT * (leaf[0] - L.DEPTH):
                template[m] = leaf
    spots = defaultdict(list)
    for spot in sorted(lines):
        spots[template.get(lines[spot], (lines[spot],))].append(spot)
    gone = {s for group in spots.values() if len({i for i, _ in group}) >= L.MIN_DOCUMENTS for s in group[1:]}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs}


def log_documents():
    pick = random.Random(5)
    names = [f"name{c}{d}" for c in "abcdefgh" for d in "xyz"]
    out = []
    for i in range(120):
        lines = [f"server started on port {pick.randrange(9000)} by user {pick.choice(names)} today again", "exact same footer line of all pages here", ""]
        lines += [" ".join(pick.choice(names) for _ in range(pick.randrange(1, 12))) for _ in range(4)]
        lines += ["the leading tokens agree " + " ".join(pick.choice("pq") for _ in range(4))]
        pick.shuffle(lines)
        out.append((i, "\n".join(lines)))
    return out


def test_matches_brute_force(spark):
    docs = log_documents()
    got = {r["doc_id"]: r["text"] for r in L.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert sum("server started" in t for t in got.values()) == 1


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    got = queries_copies.op1_line_templates(spark, FOLDER)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert canonical(got.toPandas()) == canonical(con.execute(LINE_SQL).fetchdf())


def test_edges(spark):
    docs = cases.documents(spark).withColumnRenamed("score", "n_dropped").withColumnRenamed("label", "_tideline_row").withColumnRenamed("n", "line")
    out = L.drop_recurring(docs)
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(rows) == len(cases.TEXTS)
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(t)
    assert by[1] == [cases.TEXTS[0][1]] and by[2] == ["", ""]
    assert by[3] == [None] and by[5] == [" \t\n"] and by[6] == ["!!! ???"] and by[8] == [cases.LONG]
    assert L.drop_recurring(cases.empty(spark)).count() == 0


def test_line_repeated_in_one_document_stays(spark):
    df = spark.createDataFrame([(1, "a b c d e f g\na b c d e f g\nother line"), (2, "x")], "doc_id long, text string")
    assert {r["n_dropped"] for r in L.drop_recurring(df).collect()} == {0}


def test_two_lines_that_share_little_stay_apart(spark):
    """In a leaf of two lines a token of one of them alone is no constant."""
    docs = [(1, "alpha beta gamma delta x zq zr aq ar"), (2, "alpha beta gamma delta x aq ar zq zr"), (3, "one two three four a b c d e"), (4, "one two three four a b c d f")]
    got = {r["doc_id"]: r["text"] for r in L.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and got[2] == docs[1][1] and got[4] == ""


def test_spelled_lines_are_their_tokens_and_no_text_is_carried_per_line(spark):
    said = ["", " \t", "a", " a", "a ", "a  b", "a\tb\x0bc", "x1 y 2z3 w", "12", "\x0c9a  b7c\r", "日本 語1 é", "a b \u0000 c", "wordwithoutdigit" * 50 + "!1 end"]
    df = spark.createDataFrame([(1, "\n".join(said))], "doc_id long, text string")
    parsed = L.parsed_lines(df, "doc_id", "text", L.DEPTH)
    want = {n: [L.FIELD if re.search("[0-9]", p) else p for p in re.findall(r"[^\x20\x09-\x0D]+", x)] for n, x in enumerate(said)}
    assert {r["line"]: (r["said"], r["n"]) for r in parsed.collect()} == {n: (" ".join(p), len(p)) for n, p in want.items() if p}
    # The row's key is made below the explode, or the whole text would be copied and hashed once a line.
    above = parsed._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "text#" not in above
