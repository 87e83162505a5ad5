"""SQL text builders for the DuckDB oracle of the PSI family (the same
arithmetic, written independently of the Spark code)."""

from __future__ import annotations

from vigil import config as C


def _k(keys):
    return ", ".join(keys) + ", " if keys else ""


def _on(keys):
    return " AND ".join(f"a.{k} = b.{k}" for k in keys) if keys else "TRUE"


def psi_ctes(src: str, keys: list[str], prefix: str = "p", buckets: int = C.PSI_BUCKETS) -> str:
    """CTEs computing ``{prefix}_out(keys…, psi, n_expected, n_actual)`` from a relation
    ``src(keys…, value, is_current)``."""
    qs = ", ".join(str(i / buckets) for i in range(1, buckets))
    k = _k(keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    using = f"USING ({', '.join(keys)})" if keys else "ON TRUE"
    fl = C.PSI_FLOOR
    return f"""{prefix}_clean AS (SELECT {k}value, is_current FROM {src} WHERE value IS NOT NULL AND NOT isnan(value)),
{prefix}_edges AS (SELECT {k}quantile_cont(value, [{qs}]) AS edges FROM {prefix}_clean WHERE NOT is_current {'GROUP BY ' + ', '.join(keys) if keys else ''}),
{prefix}_binned AS (SELECT {', '.join('c.' + x for x in keys) + ', ' if keys else ''}c.is_current,
    len(list_filter(e.edges, lambda x: c.value >= x)) AS bin
  FROM {prefix}_clean c JOIN {prefix}_edges e {using}),
{prefix}_grid AS (SELECT {k}unnest(range(0, {buckets})) AS bin FROM {prefix}_edges),
{prefix}_counts AS (SELECT {k}bin, count(*) FILTER (WHERE NOT is_current) AS e_cnt,
    count(*) FILTER (WHERE is_current) AS a_cnt FROM {prefix}_binned GROUP BY {k}bin),
{prefix}_full AS (SELECT {k}bin, coalesce(e_cnt, 0) AS e_cnt, coalesce(a_cnt, 0) AS a_cnt
  FROM {prefix}_grid LEFT JOIN {prefix}_counts USING ({k}bin)),
{prefix}_sh AS (SELECT {k}sum(e_cnt) OVER ({part}) AS ne, sum(a_cnt) OVER ({part}) AS na,
    e_cnt / sum(e_cnt) OVER ({part}) AS e, a_cnt / sum(a_cnt) OVER ({part}) AS a FROM {prefix}_full),
{prefix}_out AS (SELECT {k}CASE WHEN max(ne) = 0 OR max(na) = 0 THEN 0.0 ELSE
    sum((CASE WHEN a = 0 THEN {fl} ELSE a END - CASE WHEN e = 0 THEN {fl} ELSE e END)
        * ln(CASE WHEN a = 0 THEN {fl} ELSE a END / CASE WHEN e = 0 THEN {fl} ELSE e END)) END AS psi,
    max(ne) AS n_expected, max(na) AS n_actual FROM {prefix}_sh {'GROUP BY ' + ', '.join(keys) if keys else ''})"""


def long_union(src: str, features: list[str], keys: list[str], extra: str = "is_current") -> str:
    k = _k(keys)
    return " UNION ALL ".join(
        f"SELECT {k}'{f}' AS feature, CAST({f} AS DOUBLE) AS value, {extra} FROM {src}" for f in features)
