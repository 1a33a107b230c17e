"""Medication phenotypes and dictionary concept selection as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import col, contains_any, first_match, flag, lower_trim, text, upper_trim


def named(drug: Column | str, pattern: str = lx.BROAD_PATTERN) -> Column:
    """Name-only match, whatever the route."""
    return text(drug).rlike(pattern)


def broad_systemic(
    drug: Column | str,
    route: Column | str,
    pattern: str = lx.BROAD_PATTERN,
    iv_routes: Sequence[str] = ("iv",),
) -> Column:
    """Broad name, clearly intravenous, no non-systemic wording in name or route."""
    name, way = text(drug), lower_trim(route)
    clear_iv = way.isin(*iv_routes) | way.contains("intravenous")
    return name.rlike(pattern) & clear_iv & ~name.rlike(lx.NON_SYSTEMIC_TEXT) & ~way.rlike(lx.NON_SYSTEMIC_ROUTE)


def any_systemic(
    drug: Column | str,
    route: Column | str,
    pattern: str = lx.BROAD_PATTERN + "|" + lx.NON_BROAD_PATTERN,
    oral_exception: str = lx.ORAL_EXCEPTION_DRUG,
) -> Column:
    """Any listed name; the oral exception drug only when not given enterally.

    The enteral route test is unanchored, so it also hits substrings.
    """
    name, way = text(drug), lower_trim(route)
    oral = name.contains(oral_exception) & way.rlike(lx.ORAL_ENTERAL_ROUTE)
    return name.rlike(pattern) & ~name.rlike(lx.NON_SYSTEMIC_TEXT) & ~way.rlike(lx.NON_SYSTEMIC_ROUTE) & ~oral


def coded_broad(
    name: Column | str,
    code: Column | str,
    route: Column | str,
    include: Sequence[str],
    exclude: Sequence[str],
    pattern: str = lx.SITE_B_BROAD_PATTERN,
    bad_text: str = lx.SITE_B_NON_SYSTEMIC_PATTERN,
    bad_routes: Sequence[str] = lx.SITE_B_BAD_ROUTES,
) -> Column:
    """Code list or name match; an excluded code always loses."""
    n, c = F.lower(text(name)), F.trim(text(code))
    hit = n.rlike(pattern)
    if include:
        hit = hit | c.isin(*include)
    kept = ~c.isin(*exclude) if exclude else F.lit(True)
    return hit & kept & ~n.rlike(bad_text) & ~upper_trim(route).isin(*bad_routes)


def coded_non_broad(
    name: Column | str,
    route: Column | str,
    pattern: str = lx.NON_BROAD_PATTERN,
    bad_text: str = lx.SITE_B_NON_SYSTEMIC_PATTERN,
    bad_routes: Sequence[str] = lx.SITE_B_BAD_ROUTES,
) -> Column:
    n = F.lower(text(name))
    return n.rlike(pattern) & ~n.rlike(bad_text) & ~upper_trim(route).isin(*bad_routes)


def not_intravenous(
    code: Column | str,
    name: Column | str,
    route: Column | str,
    codes: Sequence[str] = lx.NON_IV_CODES,
    words: Sequence[str] = lx.NON_IV_NAMES,
    routes: Sequence[str] = lx.NON_IV_ROUTES,
) -> Column:
    return F.trim(text(code)).isin(*codes) | contains_any(lower_trim(name), words) | upper_trim(route).isin(*routes)


def drug_group(
    code: Column | str,
    name: Column | str,
    route: Column | str,
    codes: Mapping[str, str] | None = None,
    groups: Mapping[str, Iterable[str]] | None = None,
    excluded: Column | None = None,
) -> Column:
    """Code map first, then the first name group in order; null for non-intravenous rows."""
    codes = lx.CODE_TO_GROUP if codes is None else codes
    groups = lx.GROUP_NAMES if groups is None else groups
    gone = not_intravenous(code, name, route) if excluded is None else excluded
    by_name = first_match(lower_trim(name), groups)
    if codes:
        pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
        by_name = F.coalesce(F.try_element_at(pairs, F.trim(text(code))), by_name)
    return F.when(~gone, by_name)


def classify_drugs(df: DataFrame, code: str, name: str, route: str) -> DataFrame:
    """Add ``broad_drug_group``, ``is_broad_spectrum`` and ``is_systemic_antibiotic``."""
    excluded = not_intravenous(code, name, route)
    group = drug_group(code, name, route, excluded=excluded)
    systemic = ~excluded & (group.isNotNull() | contains_any(lower_trim(name), lx.NON_BROAD_NAMES))
    return df.withColumns(
        {
            "broad_drug_group": group,
            "is_broad_spectrum": group.isNotNull().cast("int"),
            "is_systemic_antibiotic": flag(systemic),
        }
    )


def mapping_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts per raw key and derived class, missing keys included."""
    derived = ["broad_drug_group", "is_broad_spectrum", "is_systemic_antibiotic"]
    return df.groupBy(*keys, *derived).agg(F.count("*").alias("n"))


def formulation(name: Column | str, route: Column | str) -> Column:
    """Inhaled before oral before injectable; otherwise unspecified."""
    n, r = F.lower(text(name)), upper_trim(route)
    out = None
    for label, words in lx.FORMULATION_WORDS.items():
        hit = contains_any(n, words) | r.isin(*lx.FORMULATION_ROUTES[label])
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit("unspecified"))


def named_without(name: Column | str, words: Sequence[str], unless: Sequence[str]) -> Column:
    n = F.lower(text(name))
    return contains_any(n, words) & ~contains_any(n, unless)


def concept_items(items: DataFrame, item: str, label: str, patterns: Mapping[str, str]) -> DataFrame:
    """(item, concept) pairs; one item may carry several concepts.

    One narrow pass over the dictionary: every pattern is tested on the row and the hits are
    exploded, instead of one filtered copy per concept.
    """
    name = F.lower(text(label))
    hits = F.array_compact(F.array(*[F.when(name.rlike(p), F.lit(c)) for c, p in patterns.items()]))
    return items.select(item, label, F.explode(hits).alias("concept")).dropDuplicates([item, "concept"])


def labelled_items(items: DataFrame, item: str, label: str, labels: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Exact label match after lower/trim; a mapping also renames to a concept."""
    name = lower_trim(label)
    if isinstance(labels, Mapping):
        concept = None
        for key, value in labels.items():
            concept = F.when(name == key, F.lit(value)) if concept is None else concept.when(name == key, F.lit(value))
        return items.select(item, label, concept.alias("concept")).where(F.col("concept").isNotNull())
    return items.select(item, label, name.alias("concept")).where(F.col("concept").isin(*labels))


def prefix_flags(code: Column, prefixes: Mapping[str, str] | None = None) -> dict[str, Column]:
    return {k: code.rlike(p) for k, p in (lx.ICD_PREFIXES if prefixes is None else prefixes).items()}


def culture_row(name: Column | str) -> Column:
    """Culture tests without reflex urinalysis panels."""
    n = F.lower(text(name))
    return n.contains("culture") & ~n.startswith("ua w culture if ind.") & ~n.contains("culture if indicated")


def culture_group(name: Column | str, groups: Mapping[str, str] | None = None) -> Column:
    """First group whose pattern fits; positivity counts and linkage rules order the groups differently."""
    n = F.lower(text(name))
    out = None
    for label, pattern in (lx.CULTURE_GROUPS if groups is None else groups).items():
        out = F.when(n.rlike(pattern), F.lit(label)) if out is None else out.when(n.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit("other_culture"))


def followup_type(name: Column | str) -> Column:
    """Susceptibility before organism; null when neither."""
    n = F.lower(text(name))
    return F.when(contains_any(n, lx.SUSCEPTIBILITY_WORDS), F.lit("susceptibility_or_mic")).when(
        contains_any(n, lx.ORGANISM_WORDS), F.lit("organism_or_identification")
    )


def sibling_class(name: Column | str) -> Column:
    return F.coalesce(first_match(F.lower(text(name)), lx.SIBLING_CLASSES), F.lit("other_lab"))


def direct_result(qualifier: Column | str, raw: Column | str) -> Column:
    """Negative wording wins over positive wording."""
    q, r = upper_trim(qualifier), F.lower(F.trim(text(raw)))
    return (
        F.when(q.isin(*lx.NEGATIVE_QUALIFIERS) | r.rlike(lx.NEGATIVE_TEXT), F.lit("direct_negative"))
        .when(q.isin(*lx.POSITIVE_QUALIFIERS) | r.rlike(lx.POSITIVE_TEXT), F.lit("direct_positive"))
        .otherwise(F.lit("direct_unresolved"))
    )


def result_text_class(raw: Column | str) -> Column:
    r = F.lower(text(raw))
    out = F.when(F.trim(r) == "", F.lit("missing_or_blank"))
    for label, pattern in lx.RESULT_TEXT_CLASSES.items():
        out = out.when(r.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit("other_text_pattern"))


def keyword_hits(df: DataFrame, columns: Sequence[str], keywords: Mapping[str, str]) -> DataFrame:
    """Rows hit per (column, keyword family), counted in one scan and then unpivoted."""
    aggs = {
        (c, k): F.count_if(F.lower(text(c)).rlike(p)) for c in columns for k, p in keywords.items()
    }
    wide = df.agg(*[a.alias(f"{c}|{k}") for (c, k), a in aggs.items()])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("keyword"), F.col(f"`{c}|{k}`").alias("n"))
            for c, k in aggs
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")
