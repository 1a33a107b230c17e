import struct

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tideline.llm import piece_codec as P
from tideline.llm.queries_format import PIECE_MODEL

DATA = P.model_bytes(PIECE_MODEL)
CODEC = P.Codec(DATA, 1)


def message(*fields):
    """Protobuf bytes from (number, value): ints, floats and bytes."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram_model(strip):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", -30.0, 6) for b in range(256))]
    scores = {"▁": -3.0, "▁a": -2.5, "▁ab": -4.0, "ab": -3.2, "a": -3.1, "b": -3.3, "c": -3.4, "abc": -5.5, "▁abc": -9.0, "bc": -3.9, "é": -6.0}
    pieces += [(p, s, 1) for p, s in scores.items()]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    return body + message((2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, int(strip)), (5, 1))))


@given(st.text(alphabet=st.one_of(st.sampled_from(" ab▁\n\té日x"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_parity_with_sentencepiece(text):
    ids, decoded, parity = next(CODEC.convert([text]))
    assert ids.tolist() == CODEC.reference.encode(text) == CODEC.encode([text])[0]
    assert parity and decoded == CODEC.reference.decode(ids.tolist()) == text.replace("▁", " ")


@given(st.text(alphabet="abc é日", max_size=30), st.booleans())
@settings(max_examples=200, deadline=None)
def test_unigram_model_with_byte_fallback(text, strip):
    data = unigram_model(strip)
    codec = P.Codec(data, 1)
    ids, decoded, parity = next(codec.convert([text]))
    assert parity and ids.tolist() == codec.reference.encode(text)
    assert decoded == codec.reference.decode(ids.tolist())


def test_given_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    whole = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    for r in P.code(docs, PIECE_MODEL).collect():
        assert r["round_trip"] and r["parity"] and r["decoded"] == r["text"] and r["ids"] == whole.encode(r["text"]) and r["n_tokens"] == len(r["ids"])


def test_edges(spark):
    docs = cases.documents(spark).withColumnRenamed("score", "ids").withColumnRenamed("n", "parity")
    out = P.code(docs, PIECE_MODEL).collect()
    assert len(out) == len(cases.TEXTS) and all(r["parity"] for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[3]["ids"] == [] and by[3]["decoded"] == "" and by[4]["ids"] == [] and by[8]["round_trip"] and by[11]["round_trip"]
    assert P.code(cases.empty(spark), PIECE_MODEL).count() == 0
