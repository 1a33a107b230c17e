"""Comparison SQL for the score model: unrolled Newton steps with a symmetric solve per step.

Only used to check the Spark results; the steps are common table expressions.
"""

from __future__ import annotations

from collections.abc import Sequence


def solved(source: str, p: int) -> str:
    """LDL' solve of H x = g over columns h{i}_{j} (i <= j) and g{i}; adds x{i}.

    One nested SELECT per unknown, so that no expression is expanded into the next.
    """
    sql = source
    for j in range(p):
        minus = "".join(f" - l{j}_{k} * l{j}_{k} * d{k}" for k in range(j))
        sql = f"(SELECT *, h{j}_{j}{minus} AS d{j} FROM {sql})"
        cols = [
            f"(h{j}_{i}" + "".join(f" - l{i}_{k} * l{j}_{k} * d{k}" for k in range(j)) + f") / d{j} AS l{i}_{j}" for i in range(j + 1, p)
        ]
        cols.append(f"g{j}" + "".join(f" - l{j}_{k} * y{k}" for k in range(j)) + f" AS y{j}")
        sql = f"(SELECT *, {', '.join(cols)} FROM {sql})"
    for i in reversed(range(p)):
        minus = "".join(f" - l{k}_{i} * x{k}" for k in range(i + 1, p))
        sql = f"(SELECT *, y{i} / d{i}{minus} AS x{i} FROM {sql})"
    return sql


def newton(data: str, p: int, name: str, steps: int = 9, ridge: float | None = None, by: str = "rep") -> str:
    """CTEs ending in ``{name}_b(by, b0..)``; ``data`` has (by, m, A, z0..)."""
    parts = [f"{name}_b0 AS MATERIALIZED (SELECT DISTINCT {by}, " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(p)) + f" FROM {data})"]
    eta = " + ".join(f"b.b{i} * d.z{i}" for i in range(p))
    for t in range(1, steps + 1):
        prev = f"{name}_b{t - 1}"
        sums = [f"sum(m * (A - mu) * z{i}) AS g{i}" for i in range(p)]
        sums += [f"sum(m * mu * (1 - mu) * z{i} * z{j}) AS h{i}_{j}" for i in range(p) for j in range(i, p)]
        parts.append(
            f"{name}_g{t} AS MATERIALIZED (SELECT {by}, sum(m) AS n, {', '.join(sums)} FROM (SELECT d.*, 1 / (1 + exp(-greatest(-35, least(35, {eta})))) AS mu FROM {data} d JOIN {prev} b USING ({by})) GROUP BY {by})"
        )
        source = f"(SELECT g.*, {', '.join(f'b.b{i}' for i in range(p))} FROM {name}_g{t} g JOIN {prev} b USING ({by}))"
        if ridge:
            fixed = ", ".join(
                [f"g{i} - {ridge} * n * b{i} AS g{i}" for i in range(p)] + [f"h{i}_{i} + {ridge} * n AS h{i}_{i}" for i in range(p)]
            )
            source = f"(SELECT * REPLACE ({fixed}) FROM {source})"
        parts.append(
            f"{name}_b{t} AS MATERIALIZED (SELECT {by}, {', '.join(f'b{i} + x{i} AS b{i}' for i in range(p))} FROM {solved(source, p)})"
        )
    parts.append(f"{name}_b AS (SELECT * FROM {name}_b{steps})")
    return ",\n".join(parts)


def score(
    base: str, continuous: Sequence[str], binary: Sequence[str], name: str = "w", squares: Sequence[str] = (), ridge: float | None = None,
    fill: str = "avg", treat: str = "A", keep: str = "u.*", steps: int = 9,
) -> str:
    """CTEs ending in ``{name}``: rows of ``base`` (keyed by unit) with ps_den and SW_A."""
    stats = [f"{fill}({c}) AS f_{c}" for c in continuous] or ["count(*) AS one"]
    after = [f"avg(coalesce({c}, f_{c})) AS m_{c}, stddev_pop(coalesce({c}, f_{c})) AS s_{c}" for c in continuous] or ["count(*) AS uno"]
    if fill == "avg":
        after = [f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in continuous] or ["count(*) AS uno"]
    z = ["1.0::DOUBLE AS z0"]
    z += [f"greatest(-8, least(8, (coalesce({c}, f_{c}) - m_{c}) / s_{c})) AS z{i}" for i, c in enumerate(continuous, 1)]
    at = len(continuous) + 1
    z += [f"coalesce({c}, 0)::DOUBLE AS z{at + i}" for i, c in enumerate(binary)]
    at += len(binary)
    z += [f"z{list(continuous).index(c) + 1} * z{list(continuous).index(c) + 1} AS z{at + i}" for i, c in enumerate(squares)]
    p = at + len(squares)
    eta = " + ".join(f"b.b{i} * d.z{i}" for i in range(p))
    ps = f"greatest(0.001, least(0.999, 1 / (1 + exp(-greatest(-35, least(35, {eta}))))))"
    return ",\n".join(
        [
            f"{name}_f AS MATERIALIZED (SELECT {', '.join(stats)}, avg({treat}) AS pn FROM {base})",
            f"{name}_k AS MATERIALIZED (SELECT {', '.join(after)} FROM {base}, {name}_f)",
            f"{name}_d AS MATERIALIZED (SELECT unit, 1 AS rep, 1 AS m, {treat} AS A, {', '.join(z)} FROM {base}, {name}_f, {name}_k)",
            newton(f"{name}_d", p, name, steps, ridge),
            f"{name}_p AS MATERIALIZED (SELECT d.unit, {ps} AS ps_den FROM {name}_d d JOIN {name}_b b USING (rep))",
            f"{name} AS MATERIALIZED (SELECT {keep}, q.ps_den, CASE WHEN u.{treat} = 1 THEN f.pn / q.ps_den ELSE (1 - f.pn) / (1 - q.ps_den) END AS SW_A FROM {base} u JOIN {name}_p q USING (unit), {name}_f f)",
        ]
    )


MIX = "(xor({x} >> 16, {x}) * 73244475) % 4294967296"


def mixed(x: str, name: str) -> list[str]:
    """Lateral aliases for the 32-bit mix; the last one is ``{name}``."""
    return [
        f"{MIX.format(x=x)} AS {name}_1",
        f"{MIX.format(x=f'{name}_1')} AS {name}_2",
        f"xor({name}_2 >> 16, {name}_2) AS {name}",
    ]


def replicates(base: str, key: str, seed: int, reps: int, name: str = "rp") -> str:
    """CTE ``{name}(rep, unit, m)`` with the Poisson(1) counts m > 0."""
    from ..operators.kernels import POISSON_CDF

    steps = ["(h1 + rep * 2654435769) % 4294967296 AS s0", *mixed("s0", "s1"), "xor(s1, h2) AS s2", *mixed("s2", "s3"), "s3 / 4294967296.0::DOUBLE AS u"]
    count = " + ".join(f"CAST(u >= {c} AS INTEGER)" for c in POISSON_CDF)
    digest = f"md5(CAST({key} AS VARCHAR) || '|{seed}')"
    return f"""{name} AS MATERIALIZED (SELECT rep, unit, {count} AS m FROM (SELECT *, {', '.join(steps)} FROM (
      SELECT unit, ('0x' || substr({digest}, 1, 8))::BIGINT AS h1, ('0x' || substr({digest}, 9, 8))::BIGINT AS h2, rep FROM {base}, (SELECT unnest(range({reps})) AS rep))) WHERE {count} > 0)"""


def replicate_score(
    base: str, continuous: Sequence[str], binary: Sequence[str], seed: int, reps: int, name: str = "w", fill: str = "avg", steps: int = 9
) -> str:
    """CTEs ending in ``{name}``: rows of every replicate with m, ps_den, SW_A and the base columns."""
    by = "rep"
    med = "avg" if fill == "avg" else "median"
    # Expanded rows (m copies) give replicate medians; weighted sums would do for means.
    expanded = f"{name}_x AS MATERIALIZED (SELECT r.rep, u.* FROM (SELECT rep, unit, unnest(range(m)) AS copy FROM rp) r JOIN {base} u USING (unit))"
    f_cols = ", ".join(f"{med}({c}) AS f_{c}" for c in continuous) or "count(*) AS one"
    if fill == "avg":
        k_cols = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in continuous) or "count(*) AS uno"
    else:
        k_cols = ", ".join(f"avg(coalesce({c}, f_{c})) AS m_{c}, stddev_pop(coalesce({c}, f_{c})) AS s_{c}" for c in continuous)
    z = ["1.0::DOUBLE AS z0"]
    z += [f"greatest(-8, least(8, (coalesce(u.{c}, f_{c}) - m_{c}) / s_{c})) AS z{i}" for i, c in enumerate(continuous, 1)]
    z += [f"coalesce(u.{c}, 0)::DOUBLE AS z{len(continuous) + 1 + i}" for i, c in enumerate(binary)]
    p = 1 + len(continuous) + len(binary)
    eta = " + ".join(f"b.b{i} * d.z{i}" for i in range(p))
    ps = f"greatest(0.001, least(0.999, 1 / (1 + exp(-greatest(-35, least(35, {eta}))))))"
    return ",\n".join(
        [
            expanded,
            f"{name}_f AS MATERIALIZED (SELECT rep, {f_cols}, avg(A) AS pn FROM {name}_x GROUP BY rep)",
            f"{name}_k AS MATERIALIZED (SELECT rep, {k_cols} FROM {name}_x JOIN {name}_f USING (rep) GROUP BY rep)",
            f"{name}_d AS MATERIALIZED (SELECT rp.rep, rp.unit, rp.m, u.A, {', '.join(z)} FROM rp JOIN {base} u USING (unit) JOIN {name}_f USING (rep) JOIN {name}_k USING (rep))",
            newton(f"{name}_d", p, name, steps, None, by),
            f"""{name} AS MATERIALIZED (SELECT q.*, CASE WHEN A = 1 THEN pn / ps_den ELSE (1 - pn) / (1 - ps_den) END AS SW_A FROM (
              SELECT d.rep, d.m, f.pn, u.*, {ps} AS ps_den FROM {name}_d d JOIN {name}_b b USING (rep) JOIN {name}_f f USING (rep) JOIN {base} u USING (unit)) q)""",
        ]
    )
