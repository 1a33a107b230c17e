"""Chat formatting by schema fingerprints.

A record is a JSON object in one of several layouts (message lists, prompt and response pairs, instructions, dialogue
strings).  The set of its nested field paths, array positions left out, is hashed; the hash selects a declarative mapping
that turns the record into canonical (role, text) turns.  The turns are written with markers; control strings inside
roles and texts are escaped, and everything can be read back from the formatted text and the loss mask alone.

Defined cases: a null role or text is an empty string; a record without turns gives an empty text; a null, malformed or
unknown record keeps its row with ``layout`` null and null results; turns keep their order, ties are sorted by role and
text in ``conversation_records``; repeated rows are repeated turns; other input columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat models read as control tokens.
CONTROL = (
    OPEN, SEP, CLOSE, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
_FIND = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_QUOTED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))
LEARNED = "assistant"

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "prompter": "user"}

#: name, paths that are always there, paths that may be there, rule.  A rule is either ("list", list path, role field,
#: text field, rename roles) or ("fields", ((role, field), ...)): fields that are absent or null give no turn.
MAPPINGS = (
    ("turns", ("turns", "turns[]", "turns[].role", "turns[].text"), (), ("list", "turns", "role", "text", False)),
    ("messages", ("messages", "messages[]", "messages[].content", "messages[].role"), (), ("list", "messages", "role", "content", False)),
    (
        "share", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), ("id", "system"),
        ("list", "conversations", "from", "value", True),
    ),
    (
        "nested", ("data", "data.dialogue", "data.dialogue[]", "data.dialogue[].speaker", "data.dialogue[].utterance"), (),
        ("list", "data.dialogue", "speaker", "utterance", True),
    ),
    ("instruction", ("instruction", "output"), ("input", "system"), ("fields", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")))),
    ("prompt", ("completion", "prompt"), ("system",), ("fields", (("system", "system"), ("user", "prompt"), ("assistant", "completion")))),
    ("response", ("prompt", "response"), ("system",), ("fields", (("system", "system"), ("user", "prompt"), ("assistant", "response")))),
    ("question", ("answer", "question"), ("context", "system"), ("fields", (("system", "system"), ("user", "context"), ("user", "question"), ("assistant", "answer")))),
)


def escape(text: str) -> str:
    """One more backslash after the first character of every control string, however many are there."""
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _QUOTED.sub(lambda m: m[0][0] + m[0][2:], text)


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; list positions are written ``[]``."""
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else k
            out.add(path)
            out |= field_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            out.add(f"{at}[]")
            out |= field_paths(v, f"{at}[]")
    return out


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def mapping_table() -> dict[str, tuple[str, tuple]]:
    """Fingerprint -> (layout, rule): every choice of optional paths; a list layout also with an empty list."""
    out: dict[str, tuple[str, tuple]] = {}
    for name, always, maybe, rule in MAPPINGS:
        shapes = [always]
        if rule[0] == "list":
            shapes.append(tuple(p for p in always if "[]" not in p))
        for shape in shapes:
            for n in range(len(maybe) + 1):
                for extra in itertools.combinations(maybe, n):
                    out[fingerprint({*shape, *extra})] = (name, rule)
    return out


def canonical_turns(record: dict, rule: tuple) -> list[tuple[str, str]]:
    as_text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if rule[0] == "fields":
        return [(role, as_text(record[field])) for role, field in rule[1] if record.get(field) is not None]
    _, path, role, text, rename = rule
    items = record
    for part in path.split("."):
        items = items[part]
    turns = [(as_text(x[role]), as_text(x[text])) for x in items or ()]
    if rename:
        turns = [(ROLES.get(r.lower(), r), t) for r, t in turns]
    if isinstance(record.get("system"), str):
        turns.insert(0, ("system", record["system"]))
    return turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """Formatted text and the half-open spans of the loss mask: the escaped texts of assistant turns."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SEP}", escape(text)
        if role == LEARNED:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), starts, ends


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns, from the formatted text alone."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        sep = formatted.index(SEP, at)
        end = formatted.index(CLOSE, sep)
        turns.append((unescape(formatted[at + len(OPEN) : sep]), unescape(formatted[sep + len(SEP) : end])))
        at = end + len(CLOSE)
    return turns


FORMATTED = "layout string, fingerprint string, formatted string, loss_starts array<int>, loss_ends array<int>"


def format_records(df: DataFrame, record: str) -> DataFrame:
    """Adds layout, fingerprint, formatted text and loss spans (code points) to rows with a JSON record column."""
    known = mapping_table()

    def one(raw: str | None) -> tuple:
        try:
            value = json.loads(raw) if raw is not None else None
        except ValueError:
            value = None
        if not isinstance(value, dict):
            return None, None, None, None, None
        mark = fingerprint(field_paths(value))
        if mark not in known:
            return None, mark, None, None, None
        layout, rule = known[mark]
        return layout, mark, *render(canonical_turns(value, rule))

    @F.pandas_udf(FORMATTED)
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["layout", "fingerprint", "formatted", "loss_starts", "loss_ends"]
        for batch in batches:
            yield pd.DataFrame([one(x) for x in batch], columns=names, dtype=object)

    return df.withColumn("_chat", convert(F.col(record))).select(*df.columns, "_chat.*")


def digests(df: DataFrame) -> DataFrame:
    """Turn and loss digests, read back from ``formatted`` and the loss spans."""

    def one(formatted: str | None, starts: object, ends: object) -> tuple:
        if formatted is None:
            return None, None, None, None, None
        turns = read_back(formatted)
        loss = "".join(unescape(formatted[a:b]) for a, b in zip(starts, ends, strict=True))
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def measure(formatted: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pd.DataFrame([one(*x) for x in zip(formatted, starts, ends, strict=True)], columns=names, dtype=object)

    return df.withColumn("_seen", measure("formatted", "loss_starts", "loss_ends")).select(*df.columns, "_seen.*")


def conversation_records(rows: DataFrame) -> DataFrame:
    """One JSON record per conversation from rows by turn (conv_id, turn, role, text); one conversation is one record."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.to_json(F.struct("turns")).alias("record"))
