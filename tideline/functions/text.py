"""Text normalisation and ordered text matching, all as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that survive ICD normalisation.  Lower case is dropped before the
# upper-casing step, as in the source definition.
ICD_DROP = "[^A-Z0-9]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def lower_trim(c: Column | str) -> Column:
    return F.lower(F.trim(text(c)))


def upper_trim(c: Column | str) -> Column:
    return F.upper(F.trim(text(c)))


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | col(c).contains(word)
    return hit


def first_match(c: Column | str, groups: Mapping[str, Iterable[str]]) -> Column:
    """Name of the first group, in mapping order, with a substring in ``c``; else null."""
    out = None
    for name, words in groups.items():
        hit = contains_any(c, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def first_rlike(c: Column | str, rules: Mapping[str, str], default: str) -> Column:
    out = None
    for name, pattern in rules.items():
        hit = col(c).rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def icd_normalised(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(text(c), ICD_DROP, ""))


def prefix_before(c: Column | str, sep: str = "|") -> Column:
    return F.lower(F.trim(F.split_part(text(c), F.lit(sep), F.lit(1))))


def flag(condition: Column) -> Column:
    """Null-safe 0/1 integer."""
    return F.coalesce(condition, F.lit(False)).cast("int")
