"""Registered feature queries (E01-E14) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.functions.calendar import season_sql
from tillsight.functions.core import ORG
from tillsight.operators import features as E
from tillsight.operators.calendar import holiday_date_features
from tillsight.plans.calendar import _f05_sql
from tillsight.plans.catalog import query, r4, with_fact
from tillsight.plans.sqlcal import holiday_ctes, season_value_sql, tenant_years_sql
from tillsight.sources.tables import sales_fact

KEYS = [ORG, "item_id", "store_id", "date"]
W = "PARTITION BY organization_id, item_id, store_id ORDER BY date"


@query("e01_time_features", with_fact("""
SELECT DISTINCT organization_id, date,
  CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month, CAST(day(date) AS BIGINT) AS day,
  CAST(isodow(date) - 1 AS BIGINT) AS dayofweek, CAST(dayofyear(date) AS BIGINT) AS dayofyear,
  CAST(weekofyear(date) AS BIGINT) AS week, CAST(quarter(date) AS BIGINT) AS quarter,
  CAST(isodow(date) >= 6 AS BIGINT) AS is_weekend, CAST(day(date) = 1 AS BIGINT) AS is_month_start,
  CAST(date = last_day(date) AS BIGINT) AS is_month_end
FROM fact"""))
def e01(spark, sf):
    """Calendar parts of every tenant sales date."""
    return E.time_features(sales_fact(spark, sf).select(ORG, "date").distinct())


_SEASONS = ("Spring", "Summer", "Monsoon", "Autumn", "Winter")


@query("e02_season_features", with_fact(f"""
WITH d AS (SELECT DISTINCT organization_id, date, {season_sql('date')} AS pakistan_season FROM fact)
SELECT organization_id, date, pakistan_season,
  {', '.join(f"CAST(pakistan_season = '{s}' AS BIGINT) AS season_{s}" for s in _SEASONS)},
  {r4('sin(2 * pi() * month(date) / 12)', 'month_sin')}, {r4('cos(2 * pi() * month(date) / 12)', 'month_cos')},
  {r4('sin(2 * pi() * (isodow(date) - 1) / 7)', 'dow_sin')}, {r4('cos(2 * pi() * (isodow(date) - 1) / 7)', 'dow_cos')},
  {r4('sin(2 * pi() * dayofyear(date) / 365)', 'doy_sin')}, {r4('cos(2 * pi() * dayofyear(date) / 365)', 'doy_cos')}
FROM d"""))
def e02(spark, sf):
    """Season label, one-hot and cyclic terms of every tenant sales date."""
    return E.season_features(sales_fact(spark, sf).select(ORG, "date").distinct())


@query("e04_weather_features", with_fact(f"""
WITH d AS (SELECT DISTINCT organization_id, date, {season_sql('date')} AS pakistan_season FROM fact),
w AS (SELECT *, CAST({season_value_sql('pakistan_season', 0, 25)} AS DOUBLE) AS temp_c,
             CAST({season_value_sql('pakistan_season', 1, 50)} AS DOUBLE) AS humidity_pct,
             CAST({season_value_sql('pakistan_season', 2, 5)} AS DOUBLE) AS rain_mm FROM d)
SELECT *, CAST(temp_c >= 35 AS BIGINT) AS is_extreme_heat, CAST(temp_c <= 10 AS BIGINT) AS is_cold_wave,
  CAST(temp_c BETWEEN 20 AND 30 AS BIGINT) AS is_comfortable_temp,
  CAST(humidity_pct >= 70 AS BIGINT) AS is_high_humidity, CAST(humidity_pct <= 30 AS BIGINT) AS is_low_humidity,
  CAST(rain_mm > 5 AS BIGINT) AS is_rainy, CAST(rain_mm > 20 AS BIGINT) AS is_heavy_rain,
  CAST(pakistan_season = 'Summer' AND temp_c >= 35 AS BIGINT) AS hot_summer,
  CAST(pakistan_season = 'Winter' AND temp_c <= 10 AS BIGINT) AS cold_winter,
  CAST(pakistan_season = 'Monsoon' AND rain_mm > 10 AS BIGINT) AS rainy_monsoon
FROM w"""))
def e04(spark, sf):
    """Season-default weather, weather flags and season × weather interactions."""
    d = sales_fact(spark, sf).select(ORG, "date").distinct()
    d = d.withColumn("pakistan_season", F.expr(season_sql("date")))
    return E.season_weather_interactions(E.weather_features(d))


@query("e06_demand_indicators_shifted", f"""
WITH hf AS ({_f05_sql('sfact')})
SELECT organization_id, date,
  CAST(in_ramadan_window = 1 OR in_eid_window = 1 AS BIGINT) AS is_pre_holiday_shopping,
  {r4('CASE WHEN days_to_holiday <= 30 THEN greatest(0, 1 - days_to_holiday / 30.0) ELSE 0 END', 'holiday_pressure')},
  CAST(isodow(date) >= 6 AND {season_sql('date')} = 'Summer' AS BIGINT) AS weekend_in_summer,
  CAST(isodow(date) >= 6 AND {season_sql('date')} = 'Winter' AS BIGINT) AS weekend_in_winter
FROM hf""")
def e06(spark, sf):
    """Pre-holiday shopping, holiday pressure, weekend × season on shifted dates."""
    f = sales_fact(spark, sf).withColumn("date", F.add_months("date", 336))
    h = holiday_date_features(f)
    h = E.time_features(h).withColumn("pakistan_season", F.expr(season_sql("date")))
    return E.demand_indicators(h).select(ORG, "date", "is_pre_holiday_shopping", "holiday_pressure",
                                         "weekend_in_summer", "weekend_in_winter")


@query("e07_lag_features", with_fact(f"""
SELECT organization_id, item_id, store_id, date, {r4('sales', 'sales')},
  {', '.join(r4(f'lag(sales, {n}) OVER ({W})', f'sales_lag_{n}') for n in E.LAGS)}
FROM fact"""))
def e07(spark, sf):
    """Sales lags 1, 7, 14, 28 rows per series."""
    return E.lag_features(sales_fact(spark, sf).select(*KEYS, "sales"))


def _roll_sql() -> str:
    parts = []
    for n in E.WINDOWS:
        fr = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts += [r4(f"avg(sales) OVER {fr}", f"sales_rolling_mean_{n}"),
                  r4(f"stddev_samp(sales) OVER {fr}", f"sales_rolling_std_{n}"),
                  r4(f"max(sales) OVER {fr}", f"sales_rolling_max_{n}"),
                  r4(f"min(sales) OVER {fr}", f"sales_rolling_min_{n}")]
    return ", ".join(parts)


@query("e08_rolling_features", with_fact(f"""
SELECT organization_id, item_id, store_id, date, {r4('sales', 'sales')}, {_roll_sql()} FROM fact"""))
def e08(spark, sf):
    """Rolling mean / std / max / min over 7, 14, 28 rows per series."""
    return E.rolling_features(sales_fact(spark, sf).select(*KEYS, "sales"))


@query("e09_price_features", with_fact(f"""
SELECT organization_id, item_id, store_id, date, {r4('sell_price', 'sell_price')},
  {r4(f'sell_price - lag(sell_price, 1) OVER ({W})', 'price_change')},
  {r4(f'sell_price - lag(sell_price, 7) OVER ({W})', 'price_momentum')},
  {r4('sell_price - avg(sell_price) OVER (PARTITION BY organization_id, item_id)', 'price_vs_avg')}
FROM fact"""))
def e09(spark, sf):
    """Price change, momentum and price vs the item's mean."""
    return E.price_features(sales_fact(spark, sf).select(*KEYS, "sell_price"))


def _e10_sql() -> str:
    lags = ", ".join(r4(f"lag(sales, {n}) OVER ({W})", f"sales_lag_{n}") for n in E.LAGS)
    sp = season_sql("date")
    t = f"CAST({season_value_sql('pakistan_season', 0, 25)} AS DOUBLE)"
    h = f"CAST({season_value_sql('pakistan_season', 1, 50)} AS DOUBLE)"
    r = f"CAST({season_value_sql('pakistan_season', 2, 5)} AS DOUBLE)"
    return with_fact(f"""
WITH w AS (
  SELECT organization_id, item_id, store_id, category, date, {r4('sales', 'sales')}, {r4('sell_price', 'sell_price')},
    {r4(f'sell_price - lag(sell_price, 1) OVER ({W})', 'price_change')},
    {r4(f'sell_price - lag(sell_price, 7) OVER ({W})', 'price_momentum')}, {lags}, {_roll_sql()},
    {r4('sell_price - avg(sell_price) OVER (PARTITION BY organization_id, item_id)', 'price_vs_avg')}
  FROM fact),
hf AS ({_f05_sql('fact')}),
b AS (SELECT w.*, {sp} AS pakistan_season, hf.is_holiday, hf.days_to_holiday, hf.days_since_holiday,
             hf.in_ramadan_window, hf.in_eid_window
      FROM w JOIN hf USING (organization_id, date)),
c AS (SELECT *, {t} AS temp_c, {h} AS humidity_pct, {r} AS rain_mm FROM b)
SELECT *,
  CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month, CAST(day(date) AS BIGINT) AS day,
  CAST(isodow(date) - 1 AS BIGINT) AS dayofweek, CAST(dayofyear(date) AS BIGINT) AS dayofyear,
  CAST(weekofyear(date) AS BIGINT) AS week, CAST(quarter(date) AS BIGINT) AS quarter,
  CAST(isodow(date) >= 6 AS BIGINT) AS is_weekend, CAST(day(date) = 1 AS BIGINT) AS is_month_start,
  CAST(date = last_day(date) AS BIGINT) AS is_month_end,
  {', '.join(f"CAST(pakistan_season = '{x}' AS BIGINT) AS season_{x}" for x in _SEASONS)},
  {r4('sin(2 * pi() * month(date) / 12)', 'month_sin')}, {r4('cos(2 * pi() * month(date) / 12)', 'month_cos')},
  {r4('sin(2 * pi() * (isodow(date) - 1) / 7)', 'dow_sin')}, {r4('cos(2 * pi() * (isodow(date) - 1) / 7)', 'dow_cos')},
  {r4('sin(2 * pi() * dayofyear(date) / 365)', 'doy_sin')}, {r4('cos(2 * pi() * dayofyear(date) / 365)', 'doy_cos')},
  CAST(temp_c >= 35 AS BIGINT) AS is_extreme_heat, CAST(temp_c <= 10 AS BIGINT) AS is_cold_wave,
  CAST(temp_c BETWEEN 20 AND 30 AS BIGINT) AS is_comfortable_temp,
  CAST(humidity_pct >= 70 AS BIGINT) AS is_high_humidity, CAST(humidity_pct <= 30 AS BIGINT) AS is_low_humidity,
  CAST(rain_mm > 5 AS BIGINT) AS is_rainy, CAST(rain_mm > 20 AS BIGINT) AS is_heavy_rain,
  CAST(pakistan_season = 'Summer' AND temp_c >= 35 AS BIGINT) AS hot_summer,
  CAST(pakistan_season = 'Winter' AND temp_c <= 10 AS BIGINT) AS cold_winter,
  CAST(pakistan_season = 'Monsoon' AND rain_mm > 10 AS BIGINT) AS rainy_monsoon,
  CAST(in_ramadan_window = 1 AND temp_c >= 35 AS BIGINT) AS hot_ramadan,
  CAST(in_ramadan_window = 1 OR in_eid_window = 1 AS BIGINT) AS is_pre_holiday_shopping,
  {r4('CASE WHEN days_to_holiday <= 30 THEN greatest(0, 1 - days_to_holiday / 30.0) ELSE 0 END', 'holiday_pressure')},
  CAST(isodow(date) >= 6 AND pakistan_season = 'Summer' AS BIGINT) AS weekend_in_summer,
  CAST(isodow(date) >= 6 AND pakistan_season = 'Winter' AS BIGINT) AS weekend_in_winter
FROM c""")


@query("e10_all_features", _e10_sql())
def e10(spark, sf):
    """The full feature frame (E01-E09) for every fact row."""
    return E.all_features(sales_fact(spark, sf))


# Numeric columns of the E10 frame in the order the operator produces them (feature positions).
E10_FEATURES = (
    ["sell_price", "price_change", "price_momentum"] + [f"sales_lag_{n}" for n in E.LAGS]
    + [f"sales_rolling_{k}_{n}" for n in E.WINDOWS for k in ("mean", "std", "max", "min")]
    + ["price_vs_avg", "year", "month", "day", "dayofweek", "dayofyear", "week", "quarter", "is_weekend",
       "is_month_start", "is_month_end"] + [f"season_{x}" for x in _SEASONS]
    + ["month_sin", "month_cos", "dow_sin", "dow_cos", "doy_sin", "doy_cos", "temp_c", "humidity_pct", "rain_mm",
       "is_extreme_heat", "is_cold_wave", "is_comfortable_temp", "is_high_humidity", "is_low_humidity", "is_rainy",
       "is_heavy_rain", "is_holiday", "days_to_holiday", "days_since_holiday", "in_ramadan_window", "in_eid_window",
       "hot_summer", "cold_winter", "rainy_monsoon", "hot_ramadan", "is_pre_holiday_shopping", "holiday_pressure",
       "weekend_in_summer", "weekend_in_winter"])


def _e11_sql() -> str:
    aggs = ", ".join(f"COUNT({c}) AS {c}__n, MIN({c}) < MAX({c}) AS {c}__v" for c in E10_FEATURES)
    rows = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS feature, {c}__n AS n_non_null, {c}__v AS varies, "
        f"({c}__n > 0 AND COALESCE({c}__v, false)) AS selected FROM agg" for i, c in enumerate(E10_FEATURES))
    return f"WITH e10 AS ({_e10_sql()}), agg AS (SELECT {aggs} FROM e10)\n{rows}"


@query("e11_feature_selection", _e11_sql())
def e11(spark, sf):
    """Which numeric columns of the full feature frame qualify as model features."""
    return E.feature_profile(E.all_features(sales_fact(spark, sf)))


@query("e12_last_vs_prior_28", with_fact("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY organization_id, item_id, store_id ORDER BY date DESC) AS rn
           FROM fact)
SELECT organization_id, item_id, store_id,
  round(SUM(CASE WHEN rn <= 28 THEN sales END), 4) AS last_sum,
  round(SUM(CASE WHEN rn > 28 AND rn <= 56 THEN sales END), 4) AS prior_sum,
  COUNT(CASE WHEN rn <= 28 THEN 1 END) AS last_rows,
  COUNT(CASE WHEN rn > 28 AND rn <= 56 THEN 1 END) AS prior_rows
FROM r GROUP BY organization_id, item_id, store_id"""))
def e12(spark, sf):
    """Sum of the last 28 rows vs the 28 before, per series."""
    return E.last_vs_prior(sales_fact(spark, sf), [ORG, "item_id", "store_id"], "sales", 28)


@query("e14_event_flags_shifted", with_fact(f"""
WITH sf AS (SELECT DISTINCT organization_id, CAST(date + INTERVAL 28 YEAR AS DATE) AS date FROM fact),
{tenant_years_sql('sf')}, {holiday_ctes()}
SELECT s.organization_id, s.date, h.name AS holiday_name,
       CAST(h.name IS NOT NULL AS BIGINT) AS has_event, h.category AS event_type
FROM sf s LEFT JOIN hol h ON h.organization_id = s.organization_id AND h.holiday_date = s.date
  AND h.table_year = year(s.date)"""))
def e14(spark, sf):
    """Event flag and type per shifted tenant date from the holiday calendar."""
    f = sales_fact(spark, sf).withColumn("date", F.add_months("date", 336)).select(ORG, "date").distinct()
    return E.event_flags(f)


@query("d14_target_correlation", f"""WITH e10 AS ({_e10_sql()}),
c AS (SELECT organization_id, {', '.join(f'corr({c}, sales) AS {c}' for c in E10_FEATURES)} FROM e10 GROUP BY 1)
{' UNION ALL '.join(f"SELECT organization_id, '{c}' AS feature, CASE WHEN isfinite({c}) THEN {r4(c, 'corr').removesuffix(' AS corr')} END AS corr FROM c" for c in E10_FEATURES)}""")
def d14(spark, sf):
    """Pearson correlation of every numeric column of the feature frame (rounded as its query gives it) with sales, per tenant."""
    from tillsight.operators import dashboards as D
    from tillsight.operators.trees import numeric_features
    frame = E.all_features(sales_fact(spark, sf))
    return D.target_correlation(frame, numeric_features(frame), digits=4)
