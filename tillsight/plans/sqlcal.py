"""Oracle-side (DuckDB SQL) text of the holiday calendar and calendar rules.

Only the fixed values are shared with the Spark side; the logic is written
independently (range joins and correlated lookups instead of exploded
equi-joins).
"""

from __future__ import annotations

from tillsight.functions import calendar as C


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def category_sql(name: str) -> str:
    n = f"lower({name})"
    whens = [f"WHEN {n} LIKE {_q('%' + kw.lower() + '%')} THEN {_q(cat)}" for kw, cat in C.HOLIDAY_KEYWORDS]
    whens += [
        f"WHEN {n} LIKE '%ramadan%' OR {n} LIKE '%ramzan%' THEN 'ramadan'",
        f"WHEN {n} LIKE '%eid%' THEN 'eid'",
        f"WHEN {n} LIKE '%ashura%' OR {n} LIKE '%muharram%' THEN 'religious'",
        f"WHEN {n} LIKE '%independence%' OR {n} LIKE '%pakistan day%' OR {n} LIKE '%defence%' THEN 'national'",
    ]
    return f"CASE WHEN {name} IS NULL THEN 'none' " + " ".join(whens) + " ELSE 'other' END"


def by_category_sql(cat: str, idx: int, default) -> str:
    whens = " ".join(f"WHEN {cat} = {_q(k)} THEN {_q(v[idx]) if isinstance(v[idx], str) else v[idx]}"
                     for k, v in C.HOLIDAY_DEMAND.items())
    d = _q(default) if isinstance(default, str) else default
    return f"CASE {whens} ELSE {d} END"


def season_value_sql(season: str, idx: int, default) -> str:
    whens = " ".join(f"WHEN {season} = {_q(k)} THEN {_q(v[idx]) if isinstance(v[idx], str) else v[idx]}"
                     for k, v in C.SEASON_WEATHER.items())
    d = _q(default) if isinstance(default, str) else default
    return f"CASE {whens} ELSE {d} END"


def holiday_ctes(years_cte: str = "yrs") -> str:
    """CTEs ``fixed_h``, ``isl_h``, ``hol`` (deduped per tenant-year-date, with category,
    multiplier, pre_days, advice) given a CTE ``yrs(organization_id, year)``."""
    fixed = ", ".join(f"({m}, {d}, {_q(n)})" for m, d, n in C.FIXED_HOLIDAYS)
    isl = ", ".join(f"({y}, {_q(n)}, DATE {_q(d)})" for y, items in C.ISLAMIC_HOLIDAYS.items() for n, d in items)
    return f"""
fixed_h(m, d, name) AS (VALUES {fixed}),
isl_h(table_year, name, holiday_date) AS (VALUES {isl}),
hol_all AS (
  SELECT y.organization_id, y.year AS table_year, f.name, make_date(y.year, f.m, f.d) AS holiday_date, 0 AS prio
  FROM {years_cte} y, fixed_h f
  UNION ALL
  SELECT y.organization_id, i.table_year, i.name, i.holiday_date, 1 AS prio
  FROM {years_cte} y JOIN isl_h i ON y.year = i.table_year),
hol0 AS (
  SELECT * FROM hol_all
  QUALIFY row_number() OVER (PARTITION BY organization_id, table_year, holiday_date ORDER BY prio, name) = 1),
hol1 AS (SELECT organization_id, table_year, name, holiday_date, {category_sql('name')} AS category FROM hol0),
hol AS (
  SELECT *, {by_category_sql('category', 0, 1.0)} AS demand_multiplier,
         {by_category_sql('category', 1, 0)} AS pre_days,
         {by_category_sql('category', 2, '')} AS advice
  FROM hol1)"""


def tenant_years_sql(src: str = "fact", date_col: str = "date", pad_next: bool = False) -> str:
    hi = f"max(year({date_col})) + 2" if pad_next else f"max(year({date_col})) + 1"
    return (f"yrs AS (SELECT organization_id, unnest(range(min(year({date_col})), {hi})) AS year "
            f"FROM {src} GROUP BY organization_id)")
