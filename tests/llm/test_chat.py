import hashlib
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import chat_schema as C
from tideline.llm import queries_format
from tools.check import canonical

FOLDER = "/root/testdata/sf0.001"
PIECES = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "|im_", ">", "[", "a", "\n", "<\\s>"]), max_size=12).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_control_strings(text):
    quoted = C.escape(text)
    assert C.unescape(quoted) == text
    assert not any(c in quoted for c in C.CONTROL)


@given(st.lists(st.tuples(st.one_of(st.just("assistant"), st.just("user"), PIECES), PIECES), max_size=5))
@settings(max_examples=200, deadline=None)
def test_turns_and_loss_are_read_back(turns):
    text, starts, ends = C.render(turns)
    assert C.read_back(text) == turns
    assert "".join(C.unescape(text[a:b]) for a, b in zip(starts, ends)) == "".join(t for r, t in turns if r == "assistant")


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{FOLDER}/conversations.parquet')")
    got = queries_format.op10_chat_format(spark, FOLDER).toPandas()
    assert canonical(got) == canonical(con.execute(queries_format.CHAT_SQL).fetchdf())


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"}, "share", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i"), ("user", "x"), ("assistant", "o")]),
        ({"prompt": "p", "completion": ""}, "prompt", [("user", "p"), ("assistant", "")]),
        ({"data": {"dialogue": [{"speaker": "Bot", "utterance": 3}]}}, "nested", [("assistant", "3")]),
        ({"messages": []}, "messages", []),
        ({"unknown": 1}, None, None),
    ],
)
def test_layouts(spark, record, layout, turns):
    df = spark.createDataFrame([(json.dumps(record), 1)], "record string, n_turns int")
    row = C.format_records(df.drop("n_turns"), "record").first()
    assert row["layout"] == layout
    assert (C.read_back(row["formatted"]) if turns is not None else row["formatted"]) == turns


def test_records_that_are_not_objects(spark):
    df = spark.createDataFrame([(None,), ("",), ("[1]",), ("{",), ("3",)], "record string")
    out = C.digests(C.format_records(df, "record")).collect()
    assert len(out) == 5 and all(r["layout"] is None and r["n_turns"] is None for r in out)
    assert C.format_records(df.limit(0), "record").count() == 0


def test_conversation_rows_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "x"), (2, 5, "assistant", "é\n" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in C.digests(C.format_records(C.conversation_records(df), "record")).collect()}
    assert out[1]["n_turns"] == 4
    assert out[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\na\nuser\na\nuser\nb\n").hexdigest()
    assert out[2]["loss_chars"] == 100_000 and out[None]["loss_sha256"] == hashlib.sha256(b"x").hexdigest()
