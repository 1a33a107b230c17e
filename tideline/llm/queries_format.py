"""Registered query of the chat operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_schema, piece_codec
from .common import ship, table
from .registry import llm_query

#: The vocabulary file is a parameter; it is read on the driver and sent along.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

SAID = "</s>[INST] ok [/INST]"

_ESCAPED = r"(<\\*\|im_start\|>|<\\*\|im_sep\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*\|system\|>|<\\*\|user\|>|<\\*\|assistant\|>|<\\*\|eot_id\|>|<\\*\|start_header_id\|>|<\\*\|end_header_id\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>)"

CHAT_SQL = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'
), said AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(role) + length(text) + 32
             + len(regexp_extract_all(role, '{_ESCAPED}')) + len(regexp_extract_all(text, '{_ESCAPED}')))::BIGINT AS formatted_chars
  FROM rows_ GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       'turns' AS layout
FROM said
"""


@llm_query("op10_chat_format", CHAT_SQL)
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -1 through the schema-fingerprint formatter, read back from its output."""
    ship(spark, "chat_schema")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], rows.schema)
    out = chat_schema.digests(chat_schema.format_records(chat_schema.conversation_records(rows.unionByName(extra)), "record"))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "layout")


@llm_query("op7_piece_codec")
def op7_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole document, whether they decode to the text and whether sentencepiece agrees."""
    ship(spark, "piece_codec")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return piece_codec.code(docs, PIECE_MODEL, results=("n_tokens", "ids", "round_trip", "parity")).drop("text")
