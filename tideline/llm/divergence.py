"""Quality rules by distribution divergence.

Two histograms per document, character classes and common words, are compared with references of each language by the
Jensen-Shannon distance (base 2, 0 to 1).  The references are counts over the whole corpus; a document is held against
the language whose common words fit it best, so a wrong or missing language tag does not matter.  Guards: a histogram is
only judged if the document has enough characters or words for its distance to mean anything.

Defined cases: a null text is an empty one: no words, base rules fail, not kept; null languages form a language of
their own; rows are judged alone, so repeated rows get equal results; an empty table gives an empty result; other input
columns pass through untouched, those named as a result give way.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import code_points, plain_word_keys, run_word_keys, windows

CLASSES = ("lower", "upper", "digit", "space", "stop", "pause", "quote", "bracket", "symbol", "other")
SYMBOLS = re.compile(r"[#*$%&|<>]")

#: Common words per language (a top-k report) and the limits of the verdict.
COMMON_WORDS = 40
MIN_CHARS, MIN_WORDS = 100, 60
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.40
#: Characters whose words a task counts at once.
FLUSH_CHARS = 8_000_000
MIN_BASE_WORDS, REPEAT_WINDOW, MAX_REPEAT_SHARE = 20, 8, 30


def _class_of(c: str) -> int:
    if c.isspace():
        return 3
    if c.isdigit():
        return 2
    if c.isalpha():
        return 1 if c.isupper() or c.istitle() else 0
    for i, members in ((4, ".!?…"), (5, ",;:-–—"), (6, "'\"’‘“”«»"), (7, "()[]{}"), (8, "#*$%&|<>@^~_=+/\\`")):
        if c in members:
            return i
    return 9


_TABLE = np.array([*(_class_of(chr(c)) for c in range(0x3000)), 0], np.int64)


def class_counts(points: np.ndarray) -> np.ndarray:
    """Code points per character class; everything from U+3000 on is a letter without case."""
    return np.bincount(_TABLE.take(points, mode="clip"), minlength=len(CLASSES))


def _information(a: np.ndarray) -> np.ndarray:
    """Sum of a log2 a along the last axis, 0 log 0 = 0."""
    return np.sum(a * np.log2(np.where(a > 0, a, 1.0)), axis=-1)


def distances(mine: np.ndarray, refs: np.ndarray, ref_information: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances between rows of shares."""
    spread = (_information(mine) + ref_information) / 2 - _information((mine + refs) / 2)
    return np.sqrt(np.maximum(spread, 0.0))


def base_counts(text: str, points: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    keys = run_word_keys(points)
    blanks = np.count_nonzero((points == 32) | ((points >= 9) & (points <= 13)))
    lines = [line for line in text.split("\n") if line.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    grams = windows(keys, REPEAT_WINDOW)
    covered = 0
    if len(grams):
        _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
        edge = np.zeros(len(keys) + 1, np.int64)
        starts = np.flatnonzero(times[back] > 1)
        edge[starts] += 1
        edge[starts + REPEAT_WINDOW] -= 1
        covered = int(np.count_nonzero(np.cumsum(edge)[:-1]))
    return len(keys), len(points) - int(blanks), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), covered


def corpus_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, name, n): character classes and words of all documents, summed inside tasks first.

    ``name`` is the position of a class or the key of a word.
    """

    def flush(chars: dict, words: dict) -> pd.DataFrame:
        parts = []
        for g, v in chars.items():
            parts.append(pd.DataFrame({"lang": g, "kind": "class", "name": np.arange(len(CLASSES)), "n": v}))
        for g, v in words.items():
            keys, n = np.unique(np.concatenate(v), return_counts=True)
            parts.append(pd.DataFrame({"lang": g, "kind": "word", "name": keys.view(np.int64), "n": n}))
        return pd.concat(parts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh = lambda: (defaultdict(lambda: np.zeros(len(CLASSES), np.int64)), defaultdict(list), 0)
        chars, words, held = fresh()
        for batch in batches:
            for language, t in zip(batch["lang"], batch["text"], strict=True):
                chars[language] += class_counts(code_points(t))
                words[language].append(plain_word_keys(t))
                held += len(t)
                if held > FLUSH_CHARS:
                    yield flush(chars, words)
                    chars, words, held = fresh()
        if chars:
            yield flush(chars, words)

    cols = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return cols.mapInPandas(count, "lang string, kind string, name long, n long").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON_WORDS) -> DataFrame:
    """(lang, kind, name, n): class counts, the ``common`` most frequent words and the number of all words per language."""
    counts = corpus_counts(docs, text, lang)
    # The best of each hashed part first, so that no language's vocabulary is gathered in one place.
    parts = counts.where("kind = 'word'").withColumn("part", F.pmod(F.col("name"), F.lit(997)))
    order = Window.partitionBy("lang", "part").orderBy(F.desc("n"), F.desc("name"))
    ranked = parts.withColumn("total", F.sum("n").over(Window.partitionBy("lang", "part"))).withColumn("r", F.row_number().over(order)).where(F.col("r") <= common)
    best = F.slice(F.sort_array(F.collect_list(F.struct("n", "name")), asc=False), 1, common).alias("best")
    words = ranked.groupBy("lang").agg(best, F.sum(F.when(F.col("r") == 1, F.col("total"))).alias("total"))
    rows = F.concat(
        F.transform("best", lambda b: F.struct(F.lit("word").alias("kind"), b["name"].alias("name"), b["n"].alias("n"))),
        F.array(F.struct(F.lit("total").alias("kind"), F.lit(0).cast("long").alias("name"), F.col("total").alias("n"))),
    )
    return counts.where("kind = 'class'").unionByName(words.select("lang", F.explode(rows).alias("x")).select("lang", "x.*"))


class References:
    """Reference histograms of all languages, held as matrices of shares."""

    def __init__(self, rows: list[tuple[str, str, str, int]]) -> None:
        by: dict = defaultdict(lambda: (np.zeros(len(CLASSES)), {}, [0]))
        for lang, kind, name, n in sorted(rows):
            chars, words, total = by[lang]
            if kind == "class":
                chars[name] = n
            elif kind == "word":
                words[name] = n
            else:
                total[0] = n
        by = {k: v for k, v in by.items() if v[0].sum() and v[2][0]}
        self.langs = list(by)
        known = [words for _, words, _ in by.values()]
        self.words = np.sort(np.array([*{w for words in known for w in words}], np.int64).view(np.uint64))
        names = self.words.view(np.int64).tolist()
        self.mask = np.array([[w in words for w in names] for words in known], float).reshape(len(by), len(names))
        named = np.array([[words.get(w, 0) for w in names] for words in known], float).reshape(len(by), len(names))
        totals = np.array([total[0] for _, _, total in by.values()], float)
        self.word_refs = np.column_stack([named, totals - named.sum(axis=1)]) / totals[:, None]
        self.char_refs = np.array([chars / chars.sum() for chars, _, _ in by.values()]).reshape(len(by), len(CLASSES))
        self.word_info, self.char_info = _information(self.word_refs), _information(self.char_refs)

    def compare(self, text: str, points: np.ndarray) -> tuple[str | None, float | None, float | None]:
        """Nearest language, and the two distances to it; null where a guard holds."""
        if not self.langs:
            return None, None, None
        keys = plain_word_keys(text)
        n = len(keys)
        by_word = by_char = np.ones(len(self.langs))
        if n:
            at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
            named = self.mask * np.bincount(at[self.words[at] == keys], minlength=len(self.words))
            by_word = distances(np.column_stack([named, n - named.sum(axis=1)]) / n, self.word_refs, self.word_info)
        if len(points):
            by_char = distances(class_counts(points) / len(points), self.char_refs, self.char_info)
        best = int(np.argmin(by_word + by_char))
        return self.langs[best], float(by_char[best]) if len(points) >= MIN_CHARS else None, float(by_word[best]) if n >= MIN_WORDS else None


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, nearest string, char_distance double, word_distance double"


def judge(docs: DataFrame, refs: list[tuple[str, str, str, int]], text: str = "text") -> DataFrame:
    """Adds base counts, distances, ``base_failed`` and ``kept`` to ``docs``."""
    # Bounded: (classes + COMMON_WORDS + 1) rows per language.
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    @F.pandas_udf(MEASURES)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        against = References(shared.value)
        for batch in batches:
            texts = [(t or "", code_points(t or "")) for t in batch]
            rows = [(*base_counts(*x), *against.compare(*x)) for x in texts]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])

    failed = (F.col("m.n_words") < MIN_BASE_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_SHARE * F.col("m.n_words"))
    far = F.coalesce(F.col("m.char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("m.word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    made = {c.split()[0] for c in MEASURES.split(", ")} | {"m", "base_failed", "kept"}
    docs = docs.drop(*[c for c in docs.columns if c in made and c != text])
    held = docs.withColumn("m", measure(F.col(text)))
    return held.select(*docs.columns, "m.*", failed.alias("base_failed"), (~failed & ~far).alias("kept"))
