"""Registered calendar queries (F02-F17) with DuckDB oracles.

``*_shifted`` variants move every sales date forward 28 years (weekdays and
leap years line up) so the 1995-2001 test dates reach the 2024-2028 Islamic
holiday table; 2029 dates then exercise the no-table fallback.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.functions import calendar as C
from tillsight.functions.core import ORG, tenant_as_of
from tillsight.operators import calendar as K
from tillsight.plans.catalog import query, r4, with_fact
from tillsight.plans.sqlcal import holiday_ctes, season_value_sql, tenant_years_sql
from tillsight.sources.tables import product_dim, read_table, sales_fact

SHIFT_MONTHS = 336


def _fact(spark, sf, shifted=False):
    f = sales_fact(spark, sf)
    return f.withColumn("date", F.add_months("date", SHIFT_MONTHS)) if shifted else f


SFACT = "sfact AS (SELECT organization_id, CAST(date + INTERVAL 28 YEAR AS DATE) AS date FROM fact)"
ASOF = "tenant_asof AS (SELECT organization_id, MAX(date) AS as_of FROM fact GROUP BY organization_id)"


def _cal_sql(src: str) -> str:
    return with_fact(f"""
WITH {SFACT}, {tenant_years_sql(src)}, {holiday_ctes()}
SELECT organization_id, CAST(table_year AS BIGINT) AS table_year, name, holiday_date, category,
       {r4('demand_multiplier', 'demand_multiplier')}, CAST(pre_days AS BIGINT) AS pre_days, advice
FROM hol""")


def _cal(spark, sf, shifted):
    return K.holiday_calendar(_fact(spark, sf, shifted)).select(
        ORG, F.col("table_year").cast("int").alias("table_year"), "name", "holiday_date", "category",
        "demand_multiplier", F.col("pre_days").cast("int").alias("pre_days"), "advice")


@query("f02_holiday_calendar", _cal_sql("fact"))
def f02(spark, sf):
    """Holiday dimension over each tenant's sales years."""
    return _cal(spark, sf, False)


@query("f02_holiday_calendar_shifted", _cal_sql("sfact"))
def f02s(spark, sf):
    """Holiday dimension over the 28-year-shifted sales years (Islamic table reached)."""
    return _cal(spark, sf, True)


def _f05_sql(src: str) -> str:
    return with_fact(f"""
WITH {SFACT}, {tenant_years_sql(src)}, {holiday_ctes()},
hd AS (SELECT DISTINCT organization_id, holiday_date, category, pre_days FROM hol),
dates AS (SELECT DISTINCT organization_id, date FROM {src})
SELECT d.organization_id, d.date,
  CAST(COALESCE((SELECT MAX(CASE WHEN h.holiday_date = d.date THEN 1 ELSE 0 END) FROM hd h
                  WHERE h.organization_id = d.organization_id), 0) AS BIGINT) AS is_holiday,
  CAST(COALESCE((SELECT MIN(date_diff('day', d.date, h.holiday_date)) FROM hd h
                  WHERE h.organization_id = d.organization_id
                    AND h.holiday_date BETWEEN d.date AND d.date + INTERVAL 90 DAY), 30) AS BIGINT)
       AS days_to_holiday,
  CAST(COALESCE((SELECT MIN(date_diff('day', h.holiday_date, d.date)) FROM hd h
                  WHERE h.organization_id = d.organization_id
                    AND h.holiday_date BETWEEN d.date - INTERVAL 90 DAY AND d.date), 30) AS BIGINT)
       AS days_since_holiday,
  CAST(COALESCE((SELECT MAX(1) FROM hd h WHERE h.organization_id = d.organization_id
                  AND h.category = 'ramadan' AND h.pre_days > 0
                  AND d.date >= h.holiday_date - to_days(CAST(h.pre_days AS INTEGER))
                  AND d.date < h.holiday_date), 0) AS BIGINT) AS in_ramadan_window,
  CAST(COALESCE((SELECT MAX(1) FROM hd h WHERE h.organization_id = d.organization_id
                  AND h.category = 'eid' AND h.pre_days > 0
                  AND d.date >= h.holiday_date - to_days(CAST(h.pre_days AS INTEGER))
                  AND d.date < h.holiday_date), 0) AS BIGINT) AS in_eid_window
FROM dates d""")


def _f05(spark, sf, shifted):
    out = K.holiday_date_features(_fact(spark, sf, shifted))
    return out.select(ORG, "date", *[F.col(c).cast("int").alias(c) for c in
                                     ("is_holiday", "days_to_holiday", "days_since_holiday",
                                      "in_ramadan_window", "in_eid_window")])


@query("f05_holiday_features", _f05_sql("fact"))
def f05(spark, sf):
    """Per tenant-date holiday flags, distances (≤ 90 days, else 30) and windows."""
    return _f05(spark, sf, False)


@query("f05_holiday_features_shifted", _f05_sql("sfact"))
def f05s(spark, sf):
    """Holiday features over 28-year-shifted dates (Ramadan / Eid windows occur)."""
    return _f05(spark, sf, True)


def _dates_as_of(spark, sf, shifted=True):
    return _fact(spark, sf, shifted).select(ORG, F.col("date").alias("as_of")).distinct()


@query("f06_pre_holiday_window_shifted", with_fact(f"""
WITH {SFACT},
dates AS (SELECT DISTINCT organization_id, date AS as_of FROM sfact),
yrs AS (SELECT DISTINCT organization_id, unnest([year(as_of), year(as_of) + 1]) AS year FROM dates),
{holiday_ctes()}
SELECT d.organization_id, d.as_of, h.name AS holiday_name, h.holiday_date,
       CAST(date_diff('day', d.as_of, h.holiday_date) AS BIGINT) AS days_until_holiday,
       CAST(h.pre_days AS BIGINT) AS pre_window_days, {r4('h.demand_multiplier', 'demand_multiplier')},
       h.advice, h.category
FROM dates d JOIN hol h ON h.organization_id = d.organization_id AND h.pre_days > 0
 AND d.as_of >= h.holiday_date - to_days(CAST(h.pre_days AS INTEGER)) AND d.as_of < h.holiday_date
 AND h.table_year IN (year(d.as_of), year(d.as_of) + 1)
QUALIFY row_number() OVER (PARTITION BY d.organization_id, d.as_of
                           ORDER BY h.holiday_date, h.table_year, h.name) = 1"""))
def f06(spark, sf):
    """For every shifted sales date: the pre-holiday window it falls in, if any."""
    return K.pre_holiday_window(_dates_as_of(spark, sf))


@query("f07_upcoming_holidays", with_fact(f"""
WITH {ASOF},
yrs AS (SELECT organization_id, unnest([year(as_of), year(as_of) + 1]) AS year FROM tenant_asof),
{holiday_ctes()}
SELECT a.organization_id, a.as_of, CAST(row_number() OVER (PARTITION BY a.organization_id
         ORDER BY h.holiday_date, h.table_year, h.name) AS BIGINT) AS rank,
       h.name, h.holiday_date, CAST(date_diff('day', a.as_of, h.holiday_date) AS BIGINT) AS days_until,
       h.category, {r4('h.demand_multiplier', 'demand_multiplier')}, h.advice
FROM tenant_asof a JOIN hol h ON h.organization_id = a.organization_id AND h.holiday_date >= a.as_of
QUALIFY rank <= 5"""))
def f07(spark, sf):
    """Next five holidays after each tenant's latest sales date."""
    return K.upcoming_holidays(tenant_as_of(sales_fact(spark, sf)), 5)


def _f08_sql() -> str:
    sm = ("CASE season WHEN 'Summer' THEN 1.15 WHEN 'Monsoon' THEN 1.05 WHEN 'Winter' THEN 1.10 "
          "ELSE 1.0 END")
    return with_fact(f"""
WITH {SFACT},
dates AS (SELECT DISTINCT organization_id, date AS as_of FROM sfact),
yrs AS (SELECT DISTINCT organization_id, unnest([year(as_of), year(as_of) + 1]) AS year FROM dates),
{holiday_ctes()},
pre AS (
  SELECT d.organization_id, d.as_of, h.name AS holiday_name, h.demand_multiplier AS hm
  FROM dates d JOIN hol h ON h.organization_id = d.organization_id AND h.pre_days > 0
   AND d.as_of >= h.holiday_date - to_days(CAST(h.pre_days AS INTEGER)) AND d.as_of < h.holiday_date
   AND h.table_year IN (year(d.as_of), year(d.as_of) + 1)
  QUALIFY row_number() OVER (PARTITION BY d.organization_id, d.as_of
                             ORDER BY h.holiday_date, h.table_year, h.name) = 1),
b AS (
  SELECT d.organization_id, d.as_of, {C.season_sql('d.as_of')} AS season, p.holiday_name,
         COALESCE(p.hm, 1.0) AS hm
  FROM dates d LEFT JOIN pre p USING (organization_id, as_of)),
c AS (SELECT *, CAST({season_value_sql('season', 0, 25)} AS DOUBLE) AS temp_c, {sm} AS sm FROM b)
SELECT organization_id, as_of, season,
  round(CAST(CASE WHEN sm > 1.0 THEN sm ELSE 1.0 END * hm *
        CASE WHEN temp_c >= 35 THEN 1.2 WHEN temp_c <= 10 THEN 1.15 ELSE 1.0 END AS DOUBLE), 2)
        AS multiplier,
  concat_ws('; ',
    CASE WHEN sm > 1.0 THEN season || ' season (' || CAST(CAST(sm AS DOUBLE) AS VARCHAR) || 'x)' END,
    CASE WHEN holiday_name IS NOT NULL THEN 'Pre-' || holiday_name || ' window ('
         || CAST(CAST(hm AS DOUBLE) AS VARCHAR) || 'x)' END,
    CASE WHEN temp_c >= 35 THEN 'Extreme heat (' || CAST(round(temp_c) AS BIGINT) || '°C - 1.2x)'
         WHEN temp_c <= 10 THEN 'Cold wave (' || CAST(round(temp_c) AS BIGINT) || '°C - 1.15x)' END)
    AS reasons,
  holiday_name IS NOT NULL AS has_pre_holiday, holiday_name
FROM c""")


@query("f08_demand_multiplier_shifted", _f08_sql())
def f08(spark, sf):
    """Season × pre-holiday × weather multiplier for every shifted sales date."""
    m = K.demand_multiplier(_dates_as_of(spark, sf))
    return m.withColumn("reasons", F.array_join("reasons", "; "))


@query("f09_holiday_stock_advice", with_fact(f"""
WITH {ASOF},
yrs AS (SELECT organization_id, unnest([year(as_of), year(as_of) + 1]) AS year FROM tenant_asof),
{holiday_ctes()},
up AS (
  SELECT a.organization_id, a.as_of, h.*, date_diff('day', a.as_of, h.holiday_date) AS du
  FROM tenant_asof a JOIN hol h ON h.organization_id = a.organization_id AND h.holiday_date >= a.as_of
  QUALIFY row_number() OVER (PARTITION BY a.organization_id ORDER BY h.holiday_date, h.table_year, h.name) <= 10)
SELECT organization_id, as_of, 'holiday_stock_up' AS type, name AS holiday, holiday_date AS date,
       CAST(du AS BIGINT) AS days_until,
       CASE WHEN du <= 14 THEN 'high' WHEN du <= 30 THEN 'medium' ELSE 'low' END AS priority,
       advice AS suggestion, {r4('demand_multiplier', 'demand_multiplier')}
FROM up WHERE advice <> ''"""))
def f09(spark, sf):
    """Stock-up advice for the next ten holidays that carry advice."""
    return K.holiday_stock_advice(tenant_as_of(sales_fact(spark, sf)), 10)


@query("f10_season_weather", with_fact(f"""
WITH d AS (SELECT DISTINCT organization_id, date FROM fact),
s AS (SELECT *, {C.season_sql('date')} AS season FROM d)
SELECT organization_id, date, season,
       CAST({season_value_sql('season', 0, 25)} AS DOUBLE) AS temp_c,
       CAST({season_value_sql('season', 1, 50)} AS DOUBLE) AS humidity_pct,
       CAST({season_value_sql('season', 2, 5)} AS DOUBLE) AS rain_mm,
       {r4(f'''CASE WHEN {season_value_sql('season', 0, 25)} >= 35 THEN 1.3
                WHEN {season_value_sql('season', 0, 25)} >= 30 THEN 1.15
                WHEN {season_value_sql('season', 0, 25)} <= 10 THEN 1.25
                WHEN {season_value_sql('season', 0, 25)} <= 15 THEN 1.1 ELSE 1.0 END
           * CASE WHEN season = 'Monsoon' THEN 1.1 ELSE 1.0 END''', 'weather_multiplier')}
FROM s"""))
def f10(spark, sf):
    """Season-default weather and weather impact multiplier (F10, F13) per tenant-date."""
    d = sales_fact(spark, sf).select(ORG, "date").distinct()
    w = K.season_weather(d)
    return w.withColumn("weather_multiplier", C.weather_impact_multiplier("temp_c", "season"))


@query("f12_fallback_forecast", with_fact(f"""
WITH {ASOF},
d AS (SELECT organization_id, CAST(as_of + to_days(CAST(k AS INTEGER)) AS DATE) AS date
      FROM tenant_asof, range(0, 7) t(k)),
s AS (SELECT *, {C.season_sql('date')} AS season FROM d)
SELECT organization_id, date,
  CAST({season_value_sql('season', 0, 25)} AS DOUBLE) AS temp_c,
  CAST({season_value_sql('season', 0, 25)} AS DOUBLE) AS feels_like_c,
  CAST({season_value_sql('season', 0, 25)} - 3 AS DOUBLE) AS temp_min_c,
  CAST({season_value_sql('season', 0, 25)} + 3 AS DOUBLE) AS temp_max_c,
  CAST({season_value_sql('season', 1, 50)} AS DOUBLE) AS humidity_pct,
  1013.0::DOUBLE AS pressure_hpa, 5.0::DOUBLE AS wind_speed_ms,
  {season_value_sql('season', 3, 'Clear')} AS weather_condition,
  season || ' conditions' AS weather_description,
  CASE WHEN season = 'Monsoon' THEN 15.0 ELSE 0.0 END::DOUBLE AS rain_mm, season
FROM s"""))
def f12(spark, sf):
    """Seven-day placeholder weather from each tenant's latest date."""
    return K.fallback_forecast(tenant_as_of(sales_fact(spark, sf)), 7)


@query("f14_extreme_weather_advice", with_fact(f"""
WITH d AS (SELECT DISTINCT organization_id, date FROM fact),
s AS (SELECT *, {C.season_sql('date')} AS season FROM d),
w AS (SELECT *, CAST({season_value_sql('season', 0, 25)} AS DOUBLE) AS t,
             CAST({season_value_sql('season', 1, 50)} AS DOUBLE) AS h,
             CAST({season_value_sql('season', 2, 5)} AS DOUBLE) AS r,
             {season_value_sql('season', 3, 'Clear')} AS cond FROM s),
a AS (SELECT *, concat_ws(' | ',
        CASE WHEN t >= 35 THEN '🔥 Extreme heat (' || CAST(round(t) AS BIGINT) || '°C) — high demand for cold drinks, water, ice cream.' END,
        CASE WHEN t <= 10 THEN '❄️ Cold wave (' || CAST(round(t) AS BIGINT) || '°C) — stock up on tea, coffee, soups, warm clothing.' END,
        CASE WHEN r > 10 OR lower(cond) LIKE '%rain%' THEN '🌧️ Heavy rain — umbrellas, raincoats, indoor snacks will see higher demand.' END,
        CASE WHEN h > 80 THEN '💧 High humidity — beverages and cold drinks may see increased demand.' END) AS adv
      FROM w)
SELECT organization_id, date, season,
  CASE WHEN adv <> '' THEN adv
       ELSE CASE season {' '.join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in C.SEASONAL_PRODUCT_DEMAND.items())} END
  END AS advice
FROM a"""))
def f14(spark, sf):
    """Extreme-weather advice per tenant-date from season-default weather."""
    d = K.season_weather(sales_fact(spark, sf).select(ORG, "date").distinct())
    d = d.withColumn("cond", C.season_lookup("season", 3, "Clear"))
    return d.select(ORG, "date", "season",
                    C.extreme_weather_advice("temp_c", "season", "humidity_pct", "cond", "rain_mm").alias("advice"))


@query("f15_seasonal_advice", with_fact(f"""
WITH {ASOF}, s AS (SELECT *, {C.season_sql('as_of')} AS season FROM tenant_asof)
SELECT organization_id, as_of, season,
  CASE season {' '.join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in C.SEASONAL_PRODUCT_DEMAND.items())} END AS advice,
  CASE season {' '.join(f"WHEN '{k}' THEN '{', '.join(v[0])}'" for k, v in C.SEASONAL_PRODUCT_DEMAND.items())} END
    AS high_demand,
  CASE season {' '.join(f"WHEN '{k}' THEN '{', '.join(v[1])}'" for k, v in C.SEASONAL_PRODUCT_DEMAND.items())} END
    AS low_demand
FROM s"""))
def f15(spark, sf):
    """Season advice and keyword lists at each tenant's latest date."""
    a = K.seasonal_demand_advice(tenant_as_of(sales_fact(spark, sf)))
    return a.withColumn("high_demand", F.array_join("high_demand", ", ")).withColumn(
        "low_demand", F.array_join("low_demand", ", "))


def _kw_values() -> str:
    rows = []
    for s, (hi, lo, _) in C.SEASONAL_PRODUCT_DEMAND.items():
        rows += [f"('{s}', 'high_demand', 0, {i}, '{k}')" for i, k in enumerate(hi)]
        rows += [f"('{s}', 'low_demand', 1, {i}, '{k}')" for i, k in enumerate(lo)]
    return ", ".join(rows)


@query("f16_seasonal_product_alerts", f"""
WITH dates AS (
  SELECT r.r_name AS organization_id, MAX(CAST(l.l_shipdate AS DATE)) AS as_of, p.p_brand, p.p_type
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL),
tenant_asof AS (SELECT organization_id, MAX(as_of) AS as_of FROM dates GROUP BY organization_id),
items AS (SELECT DISTINCT organization_id, concat_ws('/', p_brand, p_type) AS item_id FROM dates),
names AS (SELECT concat_ws('/', p_brand, p_type) AS item_id, MIN(p_name) AS name FROM part GROUP BY 1),
p AS (SELECT i.organization_id, i.item_id, n.name, {C.season_sql('a.as_of')} AS season
      FROM items i JOIN names n USING (item_id) JOIN tenant_asof a USING (organization_id)),
kw(season, alert, kind, ord, keyword) AS (VALUES {_kw_values()}),
m AS (SELECT p.*, kw.alert, kw.kind, kw.ord, kw.keyword FROM p LEFT JOIN kw
      ON kw.season = p.season AND contains(lower(p.name), kw.keyword)
      QUALIFY row_number() OVER (PARTITION BY p.organization_id, p.item_id
                                 ORDER BY kw.kind NULLS LAST, kw.ord NULLS LAST) = 1)
SELECT organization_id, item_id, name, season, COALESCE(alert, 'normal') AS alert, keyword,
  CASE alert WHEN 'high_demand' THEN '⚠️ **' || name || '** is in high demand during ' || season || '. Increase stock.'
             WHEN 'low_demand' THEN 'ℹ️ **' || name || '** has lower demand during ' || season || '. Reduce stock.'
             ELSE '' END AS message,
  CASE alert WHEN 'high_demand' THEN 'Increase stock' WHEN 'low_demand' THEN 'Reduce stock' ELSE '' END AS action
FROM m""")
def f16(spark, sf):
    """Seasonal keyword alert for every product name at the tenant's latest date."""
    fact = sales_fact(spark, sf)
    return K.seasonal_product_alerts(product_dim(spark, sf, fact), tenant_as_of(fact))


def _f17_sql() -> str:
    sm = ("CASE season WHEN 'Summer' THEN 1.15 WHEN 'Monsoon' THEN 1.05 WHEN 'Winter' THEN 1.10 "
          "ELSE 1.0 END")
    return with_fact(f"""
WITH {ASOF},
yrs AS (SELECT organization_id, unnest([year(as_of), year(as_of) + 1]) AS year FROM tenant_asof),
{holiday_ctes()},
today AS (SELECT a.organization_id, h.name AS holiday_name FROM tenant_asof a JOIN hol h
          ON h.organization_id = a.organization_id AND h.holiday_date = a.as_of AND h.table_year = year(a.as_of)),
pre AS (
  SELECT a.organization_id, h.name AS pre_holiday_name, h.demand_multiplier AS hm
  FROM tenant_asof a JOIN hol h ON h.organization_id = a.organization_id AND h.pre_days > 0
   AND a.as_of >= h.holiday_date - to_days(CAST(h.pre_days AS INTEGER)) AND a.as_of < h.holiday_date
  QUALIFY row_number() OVER (PARTITION BY a.organization_id ORDER BY h.holiday_date, h.table_year, h.name) = 1),
nxt AS (
  SELECT organization_id, string_agg(name || '@' || CAST(holiday_date AS VARCHAR) || '+' || CAST(du AS VARCHAR), '; '
                                     ORDER BY rk) AS next_holidays
  FROM (SELECT a.organization_id, h.name, h.holiday_date, date_diff('day', a.as_of, h.holiday_date) AS du,
               row_number() OVER (PARTITION BY a.organization_id ORDER BY h.holiday_date, h.table_year, h.name) AS rk
        FROM tenant_asof a JOIN hol h ON h.organization_id = a.organization_id AND h.holiday_date >= a.as_of)
  WHERE rk <= 3 GROUP BY 1),
b AS (SELECT a.organization_id, a.as_of, {C.season_sql('a.as_of')} AS season, t.holiday_name,
             p.pre_holiday_name, COALESCE(p.hm, 1.0) AS hm, n.next_holidays
      FROM tenant_asof a LEFT JOIN today t USING (organization_id) LEFT JOIN pre p USING (organization_id)
      LEFT JOIN nxt n USING (organization_id)),
c AS (SELECT *, CAST({season_value_sql('season', 0, 25)} AS DOUBLE) AS temp_c, {sm} AS sm FROM b)
SELECT organization_id, as_of, holiday_name, season,
  round(CAST(CASE WHEN sm > 1.0 THEN sm ELSE 1.0 END * hm *
        CASE WHEN temp_c >= 35 THEN 1.2 WHEN temp_c <= 10 THEN 1.15 ELSE 1.0 END AS DOUBLE), 2) AS multiplier,
  pre_holiday_name, temp_c, CAST({season_value_sql('season', 1, 50)} AS DOUBLE) AS humidity_pct,
  {season_value_sql('season', 3, 'Clear')} AS weather_condition, next_holidays,
  holiday_name IS NOT NULL AS is_holiday
FROM c""")


@query("f17_date_context", _f17_sql())
def f17(spark, sf):
    """One context record per tenant: holiday, season, weather, window, multiplier, next holidays."""
    c = K.date_context(tenant_as_of(sales_fact(spark, sf)))
    return c.withColumn("next_holidays", F.array_join(F.transform("next_holidays", lambda x: F.concat(
        x["name"], F.lit("@"), x["holiday_date"].cast("string"), F.lit("+"), x["days_until"].cast("string"))), "; "))


# Keep the read helper referenced for the events-driven variants added later.
_ = read_table


@query("f03_holidays_in_range", with_fact(f"""
WITH {ASOF},
yrs AS (SELECT organization_id, unnest(range(year(as_of - INTERVAL 30 DAY), year(as_of + INTERVAL 60 DAY) + 1)) AS year
        FROM tenant_asof),
{holiday_ctes()}
SELECT h.organization_id, CAST(h.table_year AS BIGINT) AS table_year, h.name, h.holiday_date, h.category
FROM hol h JOIN tenant_asof a USING (organization_id)
WHERE h.holiday_date BETWEEN a.as_of - INTERVAL 30 DAY AND a.as_of + INTERVAL 60 DAY"""))
def f03(spark, sf):
    """Holidays from 30 days before to 60 days after each tenant's latest date."""
    a = tenant_as_of(sales_fact(spark, sf))
    return K.holidays_in_range(a, F.date_sub("as_of", 30), F.date_add("as_of", 60)).select(
        ORG, "table_year", "name", "holiday_date", "category")
