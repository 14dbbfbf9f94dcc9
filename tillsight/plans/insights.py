"""Registered insight, executive and drill-down queries (I01-I17) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.functions.calendar import season_sql
from tillsight.functions.core import ORG
from tillsight.operators import insights as I
from tillsight.operators import inventory as H
from tillsight.plans.catalog import query, r4, with_fact
from tillsight.plans.inventory import KPI_SQL, SCENARIOS, STATS_STOCK, _dec_sql, _stats
from tillsight.plans.sqlcal import holiday_ctes, season_value_sql, tenant_years_sql
from tillsight.sources.tables import SalesTables, read_table, sales_fact

OBS_GROWTH = """
WITH d AS (SELECT {keys}, date, SUM(sales) AS sales FROM fact GROUP BY {keys}, date),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date DESC) AS rn FROM d),
g AS (SELECT {keys}, COALESCE(SUM(CASE WHEN rn <= 28 THEN sales END), 0) AS last_sum,
             COALESCE(SUM(CASE WHEN rn > 28 AND rn <= 56 THEN sales END), 0) AS prior_sum
      FROM r GROUP BY {keys}),
gg AS (SELECT *, CASE WHEN prior_sum > 0 THEN (last_sum - prior_sum) / prior_sum * 100 END AS growth_pct FROM g)"""


@query("i01_overall", with_fact(f"""
WITH d AS (SELECT organization_id, AVG(s) AS avg_daily FROM
           (SELECT organization_id, date, SUM(sales) AS s FROM fact GROUP BY 1, 2) GROUP BY 1)
SELECT f.organization_id, COUNT(DISTINCT item_id) AS items, COUNT(DISTINCT store_id) AS stores,
       COUNT(DISTINCT date) AS days, {r4('SUM(sales)', 'total_sales')},
       {r4('SUM(sales * sell_price)', 'revenue')}, {r4('MAX(d.avg_daily)', 'avg_daily')}
FROM fact f JOIN d USING (organization_id) GROUP BY f.organization_id"""))
def i01(spark, sf):
    """Overview numbers per tenant."""
    return I.overall_numbers(sales_fact(spark, sf))


@query("i02_trend", with_fact(f"""
WITH d AS (SELECT organization_id, date, SUM(sales) AS sales FROM fact GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY date DESC) AS rn FROM d),
t AS (SELECT organization_id, COUNT(*) AS n_days, AVG(CASE WHEN rn <= 7 THEN sales END) AS recent_mean,
             AVG(CASE WHEN rn > 7 AND rn <= 14 THEN sales END) AS prior_mean FROM r GROUP BY 1 HAVING COUNT(*) >= 14),
w AS (SELECT organization_id, isodow(date) - 1 AS dow, AVG(sales) AS m FROM fact GROUP BY 1, 2),
ws AS (SELECT organization_id, arg_min(dow, (-m, dow)) AS best_dow, arg_min(dow, (m, dow)) AS worst_dow,
              (MAX(m) - MIN(m)) / AVG(m) * 100 AS sp, COUNT(*) AS n_dow FROM w GROUP BY 1)
SELECT t.organization_id, t.n_days, {r4('recent_mean', 'recent_mean')}, {r4('prior_mean', 'prior_mean')},
  {r4('CASE WHEN prior_mean > 0 THEN (recent_mean - prior_mean) / prior_mean * 100 END', 'change_pct')},
  CAST(best_dow AS BIGINT) AS best_dow, CAST(worst_dow AS BIGINT) AS worst_dow, n_dow, {r4('sp', 'dow_spread_pct')}
FROM t LEFT JOIN ws USING (organization_id)"""))
def i02(spark, sf):
    """Last-7 vs prior-7 observed days and weekday strength per tenant."""
    return I.trend_numbers(sales_fact(spark, sf))


@query("i03_products", with_fact(f"""
WITH p AS (SELECT organization_id, item_id, SUM(sales) AS units FROM fact GROUP BY 1, 2),
a AS (SELECT organization_id, COUNT(*) AS n_items, SUM(units) AS total_units,
             quantile_cont(units, 0.5) AS median_units FROM p GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY units DESC, item_id) AS rk FROM p),
t AS (SELECT organization_id, string_agg(item_id || '=' || CAST(round(units, 4) AS VARCHAR), ', ' ORDER BY rk) AS top3,
             SUM(units) AS top3_units FROM r WHERE rk <= 3 GROUP BY 1),
s AS (SELECT p.organization_id, COUNT(CASE WHEN units < median_units * 0.1 THEN 1 END) AS slow_movers
      FROM p JOIN a USING (organization_id) GROUP BY 1)
SELECT organization_id, n_items, {r4('total_units', 'total_units')}, {r4('median_units', 'median_units')}, top3,
       {r4('top3_units', 'top3_units')}, slow_movers, {r4('top3_units / total_units * 100', 'top3_pct')}
FROM a JOIN t USING (organization_id) JOIN s USING (organization_id)"""))
def i03(spark, sf):
    """Top three items, their share and slow movers per tenant."""
    p = I.product_numbers(sales_fact(spark, sf))
    return p.withColumn("top3", F.array_join(F.transform("top3", lambda s: F.concat(
        s["item_id"], F.lit("="), F.round(s["units"], 4).cast("string"))), ", "))


@query("i04_stores", with_fact(f"""
WITH s AS (SELECT organization_id, store_id, SUM(sales) AS units FROM fact GROUP BY 1, 2)
SELECT organization_id, COUNT(*) AS n_stores, arg_min(store_id, (-units, store_id)) AS top_store,
       {r4('MAX(units)', 'top_units')}, {r4('MIN(units)', 'bottom_units')}, {r4('MAX(units) / MIN(units)', 'ratio')}
FROM s GROUP BY 1"""))
def i04(spark, sf):
    """Best store and best / worst ratio per tenant."""
    return I.store_numbers(sales_fact(spark, sf))


@query("i05_seasonality", with_fact(f"""
WITH m AS (SELECT organization_id, year(date) AS y, month(date) AS mo, SUM(sales) AS units FROM fact GROUP BY 1, 2, 3),
mm AS (SELECT organization_id, COUNT(*) AS n_months, arg_min((y, mo, units), (-units, y, mo)) AS pk,
              arg_min((y, mo, units), (units, y, mo)) AS lo FROM m GROUP BY 1),
u AS (SELECT organization_id, COALESCE(AVG(CASE WHEN isodow(date) >= 6 THEN sales END), 0) AS we,
             COALESCE(AVG(CASE WHEN isodow(date) < 6 THEN sales END), 1) AS wd FROM fact GROUP BY 1)
SELECT organization_id, n_months, CAST(pk[1] AS BIGINT) AS peak_year, CAST(pk[2] AS BIGINT) AS peak_month,
       {r4('pk[3]', 'peak_units')}, CAST(lo[1] AS BIGINT) AS low_year, CAST(lo[2] AS BIGINT) AS low_month,
       {r4('lo[3]', 'low_units')}, {r4('we', 'weekend_mean')}, {r4('wd', 'weekday_mean')},
       {r4('CASE WHEN wd > 0 THEN (we - wd) / wd * 100 END', 'weekend_uplift_pct')}
FROM mm JOIN u USING (organization_id)"""))
def i05(spark, sf):
    """Peak / lowest month and weekend effect per tenant."""
    m = I.seasonality_numbers(sales_fact(spark, sf))
    return m.select(ORG, "n_months", F.col("peak.year").alias("peak_year"), F.col("peak.month").alias("peak_month"),
                    F.col("peak.units").alias("peak_units"), F.col("low.year").alias("low_year"),
                    F.col("low.month").alias("low_month"), F.col("low.units").alias("low_units"),
                    "weekend_mean", "weekday_mean", "weekend_uplift_pct")


@query("i06_anomalies", with_fact(f"""
WITH q AS (SELECT organization_id, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3,
                  COUNT(sales) AS n_rows FROM fact GROUP BY 1)
SELECT organization_id, {r4('q1', 'q1')}, {r4('q3', 'q3')}, n_rows,
       COUNT(CASE WHEN sales > q3 + 3 * (q3 - q1) THEN 1 END) AS n_high,
       {r4('COUNT(CASE WHEN sales > q3 + 3 * (q3 - q1) THEN 1 END) / n_rows * 100', 'high_pct')}
FROM fact JOIN q USING (organization_id) GROUP BY organization_id, q1, q3, n_rows"""))
def i06(spark, sf):
    """Rows above Q3 + 3·IQR per tenant."""
    return I.anomaly_numbers(sales_fact(spark, sf))


@query("i07_seasons", with_fact(f"""
WITH s AS (SELECT organization_id, {season_sql('date')} AS season, SUM(sales) AS su FROM fact GROUP BY 1, 2)
SELECT organization_id, COUNT(*) AS n_seasons, arg_min(season, (-su, season)) AS best_season,
       {r4('arg_min(su, (-su, season))', 'best_sum')}, arg_min(season, (su, season)) AS worst_season,
       {r4('arg_min(su, (su, season))', 'worst_sum')}, {r4('MAX(su) / MIN(su)', 'ratio')}
FROM s GROUP BY 1"""))
def i07(spark, sf):
    """Best / worst season by sales per tenant."""
    s = I.season_numbers(sales_fact(spark, sf))
    return s.select(ORG, "n_seasons", F.col("best.season").alias("best_season"), F.col("best.sum").alias("best_sum"),
                    F.col("worst.season").alias("worst_season"), F.col("worst.sum").alias("worst_sum"), "ratio")


@query("i08_weather_bands", with_fact(f"""
WITH t AS (SELECT organization_id, sales,
             CAST({season_value_sql(season_sql('date'), 0, 25)} AS DOUBLE) AS temp_c FROM fact),
b AS (SELECT *, CASE WHEN temp_c > 0 AND temp_c <= 15 THEN '<15°C' WHEN temp_c > 15 AND temp_c <= 25 THEN '15-25°C'
                     WHEN temp_c > 25 AND temp_c <= 35 THEN '25-35°C' WHEN temp_c > 35 AND temp_c <= 50 THEN '>35°C'
                END AS band FROM t),
g AS (SELECT organization_id, band, CASE band WHEN '<15°C' THEN 0 WHEN '15-25°C' THEN 1 WHEN '25-35°C' THEN 2
                                             ELSE 3 END AS o, AVG(sales) AS a FROM b WHERE band IS NOT NULL GROUP BY 1, 2)
SELECT organization_id, COUNT(*) AS n_bands, arg_min(band, (-a, o)) AS max_band, {r4('MAX(a)', 'max_avg')},
       arg_min(band, (a, o)) AS min_band, {r4('MIN(a)', 'min_avg')}
FROM g GROUP BY 1"""))
def i08(spark, sf):
    """Mean sales by season-default temperature band per tenant."""
    w = I.weather_numbers(sales_fact(spark, sf))
    return w.select(ORG, "n_bands", F.col("max_band.band").alias("max_band"),
                    F.col("max_band.avg_sales").alias("max_avg"), F.col("min_band.band").alias("min_band"),
                    F.col("min_band.avg_sales").alias("min_avg"))


@query("i09_holiday_impact", with_fact(f"""
WITH {tenant_years_sql('fact')}, {holiday_ctes()},
hd AS (SELECT DISTINCT organization_id, holiday_date FROM hol),
f AS (SELECT f.organization_id, f.sales, CASE WHEN h.holiday_date IS NULL THEN 0 ELSE 1 END AS ih
      FROM fact f LEFT JOIN hd h ON h.organization_id = f.organization_id AND h.holiday_date = f.date),
a AS (SELECT organization_id, SUM(ih) AS holiday_rows, AVG(CASE WHEN ih = 1 THEN sales END) AS hm,
             AVG(CASE WHEN ih = 0 THEN sales END) AS om FROM f GROUP BY 1),
b AS (SELECT organization_id, holiday_rows, CASE WHEN holiday_rows > 0 THEN hm ELSE 0 END AS hm,
             COALESCE(om, 1) AS om FROM a)
SELECT organization_id, CAST(holiday_rows AS BIGINT) AS holiday_rows, {r4('hm', 'holiday_mean')},
       {r4('om', 'other_mean')}, {r4('CASE WHEN om > 0 THEN (hm - om) / om * 100 END', 'uplift_pct')}
FROM b"""))
def i09(spark, sf):
    """Holiday vs other-day mean sales per tenant."""
    return I.holiday_numbers(sales_fact(spark, sf))


@query("i10_insights")
def i10(spark, sf):
    """All insight sentences for every tenant (rows only; numbers checked by I01-I09)."""
    return I.insights(sales_fact(spark, sf))


@query("i11_executive_overview", with_fact(OBS_GROWTH.format(keys="organization_id") + f""",
dec AS ({_dec_sql(STATS_STOCK, SCENARIOS[:1])}),
fin AS (SELECT organization_id, round(SUM(inventory_value), 2) AS iv, round(SUM(overstock_capital), 2) AS oc,
               round(SUM(potential_savings), 2) AS ps FROM dec GROUP BY 1),
b AS (SELECT organization_id, SUM(sales) AS ts, SUM(sales * COALESCE(sell_price, 0)) AS rev,
             COUNT(DISTINCT date) AS days_covered, COUNT(DISTINCT item_id) AS products,
             COUNT(DISTINCT store_id) AS stores FROM fact GROUP BY 1)
SELECT organization_id, round(ts, 2) AS total_sales, round(rev, 2) AS revenue,
       round(ts / days_covered, 2) AS avg_daily_sales, round(growth_pct, 1) AS growth_pct, products, stores,
       days_covered, round(iv, 2) AS inventory_value, round(oc, 2) AS overstock_capital,
       round(ps, 2) AS potential_savings
FROM b JOIN gg USING (organization_id) JOIN fin USING (organization_id)"""))
def i11(spark, sf):
    """Executive totals, 28-day growth and inventory money per tenant."""
    t = SalesTables(spark, sf)
    fin = H.financial_summary(H.purchase_decisions(_stats(spark, sf, tables=t)))
    return I.executive_overview(t.fact(), fin)


@query("i11_executive_opportunities", with_fact(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY organization_id, item_id ORDER BY date DESC, store_id DESC) AS rn
           FROM fact),
g AS (SELECT organization_id, item_id, COALESCE(SUM(CASE WHEN rn <= 28 THEN sales END), 0)
             - COALESCE(SUM(CASE WHEN rn > 28 AND rn <= 56 THEN sales END), 0) AS gu FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY gu DESC, item_id) AS rank FROM g)
SELECT organization_id, CAST(rank AS BIGINT) AS rank, 'product_growth' AS type, item_id, {r4('gu', 'units')},
       item_id || ' growing (+' || CAST(CAST(round(gu) AS BIGINT) AS VARCHAR) || ' units vs prior month)' AS message
FROM k WHERE rank <= 3 AND gu > 0"""))
def i11o(spark, sf):
    """Top three growing items per tenant (row-based 28 vs prior 28)."""
    return I.executive_opportunities(sales_fact(spark, sf))


def _exec_parts(spark, sf):
    t = SalesTables(spark, sf)
    fact = t.fact()
    dec = H.purchase_decisions(_stats(spark, sf, tables=t))
    fin = H.financial_summary(dec)
    ov = I.executive_overview(fact, fin)
    return fact, dec, fin, ov


EXEC_SQL = with_fact(OBS_GROWTH.format(keys="organization_id") + f""",
dec AS ({_dec_sql(STATS_STOCK, SCENARIOS[:1])}),
fin AS (SELECT organization_id, {KPI_SQL} FROM dec GROUP BY 1),
ov AS (SELECT f.organization_id, round(SUM(sales), 2) AS total_sales, round(SUM(sales * COALESCE(sell_price, 0)), 2) AS revenue,
              round(MAX(gg.growth_pct), 1) AS growth_pct FROM fact f JOIN gg USING (organization_id) GROUP BY 1),
ra AS (SELECT organization_id, 1 AS priority, 2 AS seq, 'revenue_decline' AS type, 'high' AS severity,
              'Revenue down ' || printf('%.0f', abs(growth_pct)) || '% month-over-month' AS title,
              'Investigate demand shifts, stockouts, or pricing before it compounds.' AS detail FROM ov WHERE growth_pct < -10
       UNION ALL SELECT organization_id, 2, 1, 'reorder', 'medium', CAST(items_to_reorder AS VARCHAR) || ' items need reordering',
              'Estimated order value $' || format('{{:,.0f}}', total_recommended_order_value) FROM fin WHERE items_to_reorder > 0)""")


@query("i11_action_texts", EXEC_SQL + f""",
t_asof AS (SELECT organization_id, MAX(date) AS as_of FROM fact GROUP BY 1),
chg AS (SELECT organization_id, item_id, store_id, (rc - pr) / pr * 100 AS pct FROM (
  SELECT f.organization_id, f.item_id, f.store_id, COALESCE(SUM(CASE WHEN f.date > a.as_of - INTERVAL 7 DAY THEN f.sales END), 0) AS rc,
         COALESCE(SUM(CASE WHEN f.date <= a.as_of - INTERVAL 7 DAY AND f.date > a.as_of - INTERVAL 28 DAY THEN f.sales END), 0) AS pr
  FROM fact f JOIN t_asof a USING (organization_id) GROUP BY 1, 2, 3) WHERE pr > 0),
sd AS (SELECT organization_id, store_id, date, SUM(sales) AS sales FROM fact GROUP BY 1, 2, 3),
sz AS (SELECT organization_id, store_id, (rm - hm) / hs AS z FROM (
  SELECT d.organization_id, d.store_id, AVG(CASE WHEN d.date > a.as_of - INTERVAL 7 DAY THEN sales END) AS rm,
         AVG(CASE WHEN d.date <= a.as_of - INTERVAL 7 DAY THEN sales END) AS hm, STDDEV_SAMP(CASE WHEN d.date <= a.as_of - INTERVAL 7 DAY THEN sales END) AS hs,
         COUNT(CASE WHEN d.date <= a.as_of - INTERVAL 7 DAY THEN 1 END) AS hn
  FROM sd d JOIN t_asof a USING (organization_id) GROUP BY 1, 2) WHERE hn >= 14 AND hs > 0),
yrs AS (SELECT organization_id, unnest([year(as_of), year(as_of) + 1]) AS year FROM t_asof),
{holiday_ctes()},
up AS (SELECT a.organization_id, h.name, date_diff('day', a.as_of, h.holiday_date) AS du
  FROM t_asof a JOIN hol h ON h.organization_id = a.organization_id AND h.holiday_date >= a.as_of
  QUALIFY row_number() OVER (PARTITION BY a.organization_id ORDER BY h.holiday_date, h.table_year, h.name) <= 10),
al AS (
  SELECT organization_id, 'stockout_risk' AS type, CASE WHEN stockout_in_days <= 3 THEN 'critical' ELSE 'high' END AS severity,
         'Stockout risk: ' || item_id || ' @ ' || store_id AS title, 'Stock runs out in ~' || CAST(CAST(round_even(stockout_in_days, 0) AS BIGINT) AS VARCHAR)
         || ' days. Order ' || CAST(CAST(round_even(recommended_order_qty, 0) AS BIGINT) AS VARCHAR) || ' units now.' AS detail
    FROM dec WHERE stockout_in_days <= 7
  UNION ALL SELECT organization_id, 'overstock', 'medium', 'Overstock: ' || item_id || ' @ ' || store_id,
         CAST(CAST(round_even(days_of_stock, 0) AS BIGINT) AS VARCHAR) || ' days of stock ($' || format('{{:,.0f}}', COALESCE(overstock_capital, 0)) || ' tied up).'
    FROM dec WHERE days_of_stock > 90
  UNION ALL SELECT organization_id, 'demand_spike', 'high', 'Demand spike: ' || item_id || ' @ ' || store_id,
         'Sales up ' || CAST(CAST(round_even(pct, 0) AS BIGINT) AS VARCHAR) || '% in the last 7 days. Consider stocking up.' FROM chg WHERE pct >= 40
  UNION ALL SELECT organization_id, 'demand_drop', 'medium', 'Demand drop: ' || item_id || ' @ ' || store_id,
         'Sales down ' || CAST(CAST(round_even(abs(pct), 0) AS BIGINT) AS VARCHAR) || '% in the last 7 days.' FROM chg WHERE pct <= -40
  UNION ALL SELECT organization_id, 'store_performance', CASE WHEN abs(z) > 3 THEN 'high' ELSE 'medium' END, 'Store anomaly: ' || store_id,
         store_id || ' is running ' || printf('%.1f', abs(z)) || 'σ ' || CASE WHEN z > 0 THEN 'above' ELSE 'below' END || ' its historical average this week.'
    FROM sz WHERE abs(z) > 2
  UNION ALL SELECT organization_id, 'upcoming_holiday', 'info', 'Upcoming holiday: ' || name, name || ' is in ' || CAST(du AS VARCHAR) || ' days. Stock up early.'
    FROM up WHERE du BETWEEN 0 AND 7)
SELECT organization_id, CAST(CASE WHEN severity IN ('critical', 'high') THEN 1 ELSE 2 END AS BIGINT) AS priority, type, title, detail, severity FROM al
UNION ALL SELECT organization_id, CAST(priority AS BIGINT), type, title, detail, severity FROM ra""")
def i11t(spark, sf):
    """Priority, title and text of every executive action, without its position."""
    return i11a(spark, sf).drop("position")


@query("i11_executive_actions")
def i11a(spark, sf):
    """Prioritised executive actions per tenant (rows only)."""
    from tillsight.operators import alerts as A
    fact, dec, fin, ov = _exec_parts(spark, sf)
    alerts = A.to_table_rows(A.new_alerts(A.detect_all(fact, dec), None), "2001-11-05 00:00:00")
    return I.executive_actions(alerts, fin, ov)


@query("i12_store_intelligence", with_fact(OBS_GROWTH.format(keys="organization_id, store_id") + f""",
b AS (SELECT organization_id, store_id, SUM(sales) AS ts, SUM(sales * COALESCE(sell_price, 0)) AS rev,
             COUNT(DISTINCT item_id) AS products, COUNT(DISTINCT date) AS days_covered FROM fact GROUP BY 1, 2),
v AS (SELECT organization_id, store_id, AVG(m) AS vel FROM
        (SELECT organization_id, store_id, item_id, AVG(sales) AS m FROM fact GROUP BY 1, 2, 3) GROUP BY 1, 2),
dw AS (SELECT organization_id, store_id, isodow(date) - 1 AS dow, AVG(sales) AS m FROM d GROUP BY 1, 2, 3),
dws AS (SELECT organization_id, store_id,
               CASE WHEN AVG(m) > 0 THEN (MAX(m) - MIN(m)) / AVG(m) * 100 ELSE 0 END AS sp,
               arg_min(dow, (-m, dow)) AS pk FROM dw GROUP BY 1, 2),
wt AS (SELECT organization_id, store_id,
         CASE WHEN COUNT(*) >= 10 AND STDDEV_SAMP(t) > 0 THEN round(corr(sales, t), 2) END AS ws
       FROM (SELECT *, CAST({season_value_sql(season_sql('date'), 0, 25)} AS DOUBLE) AS t FROM d) GROUP BY 1, 2)
SELECT organization_id, store_id, round(ts, 2) AS total_sales, round(rev, 2) AS revenue, products,
  round(ts / days_covered, 2) AS avg_daily_sales, round(growth_pct, 1) AS growth_pct, round(vel, 2) AS sales_velocity,
  round(sp, 1) AS day_of_week_spread_pct,
  ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][pk + 1] AS peak_day, ws AS weather_sensitivity, days_covered
FROM b JOIN gg USING (organization_id, store_id) JOIN v USING (organization_id, store_id)
  JOIN dws USING (organization_id, store_id) JOIN wt USING (organization_id, store_id)"""))
def i12(spark, sf):
    """Store drill-down for every store of every tenant (best products in I12b)."""
    return I.store_intelligence(sales_fact(spark, sf)).drop("best_products")


@query("i12_store_best_products", with_fact(f"""
WITH p AS (SELECT organization_id, store_id, item_id, SUM(sales) AS units, COUNT(DISTINCT date) AS days
           FROM fact GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY organization_id, store_id ORDER BY units DESC, item_id) AS rank FROM p)
SELECT organization_id, store_id, CAST(rank AS BIGINT) AS rank, item_id, {r4('units', 'units')},
       {r4('units / days', 'avg_daily')}
FROM r WHERE rank <= 5"""))
def i12b(spark, sf):
    """Five best items of every store."""
    s = I.store_intelligence(sales_fact(spark, sf))
    return s.select(ORG, "store_id", F.explode("best_products").alias("b")).select(ORG, "store_id", "b.*")


@query("i13_product_intelligence", with_fact(OBS_GROWTH.format(keys="organization_id, item_id") + f""",
{tenant_years_sql('fact')}, {holiday_ctes()},
hd AS (SELECT DISTINCT organization_id, holiday_date FROM hol),
b AS (SELECT organization_id, item_id, MIN(category) AS category, SUM(sales) AS ts,
             SUM(sales * COALESCE(sell_price, 0)) AS rev, COUNT(DISTINCT store_id) AS stores FROM fact GROUP BY 1, 2),
st AS (SELECT organization_id, item_id, arg_min(store_id, (-u, store_id)) AS top_store, MAX(u) AS top_units FROM
        (SELECT organization_id, item_id, store_id, SUM(sales) AS u FROM fact GROUP BY 1, 2, 3) GROUP BY 1, 2),
ix AS (SELECT *, CAST(row_number() OVER (PARTITION BY organization_id, item_id ORDER BY date) - 1 AS DOUBLE) AS i FROM d),
ds AS (SELECT organization_id, item_id, COUNT(*) AS days_covered, AVG(sales) AS mean, STDDEV_SAMP(sales) AS sd,
              regr_slope(sales, i) AS slope FROM ix GROUP BY 1, 2),
mo AS (SELECT organization_id, item_id, arg_min(m, (-a, m)) AS peak_month FROM
        (SELECT organization_id, item_id, month(date) AS m, AVG(sales) AS a FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2),
dw AS (SELECT organization_id, item_id, CASE WHEN AVG(m) > 0 THEN (MAX(m) - MIN(m)) / AVG(m) * 100 ELSE 0 END AS sp
       FROM (SELECT organization_id, item_id, isodow(date) AS w, AVG(sales) AS m FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2),
hs AS (SELECT d.organization_id, d.item_id, SUM(CASE WHEN h.holiday_date IS NULL THEN 0 ELSE 1 END) AS nh,
              AVG(CASE WHEN h.holiday_date IS NOT NULL THEN sales END) AS ha,
              AVG(CASE WHEN h.holiday_date IS NULL THEN sales END) AS ba
       FROM d LEFT JOIN hd h ON h.organization_id = d.organization_id AND h.holiday_date = d.date GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN mean > 0 AND days_covered > 1 THEN sd / mean ELSE 0 END AS cv
      FROM b JOIN st USING (organization_id, item_id) JOIN ds USING (organization_id, item_id)
        JOIN mo USING (organization_id, item_id) JOIN dw USING (organization_id, item_id)
        JOIN hs USING (organization_id, item_id) JOIN gg USING (organization_id, item_id))
SELECT organization_id, item_id, category, round(ts, 2) AS total_sales, round(rev, 2) AS revenue, stores,
  round(ts / days_covered, 2) AS avg_daily_sales, round(growth_pct, 1) AS growth_pct,
  CASE WHEN days_covered >= 2 THEN round(slope, 3) END AS trend_slope, top_store,
  CASE WHEN ts > 0 THEN round(top_units / ts * 100, 1) END AS top_store_pct, round(sp, 1) AS day_of_week_spread_pct,
  CAST(peak_month AS BIGINT) AS peak_month, round(cv, 2) AS demand_cv,
  CASE WHEN cv > 1.5 THEN 'high' WHEN cv > 0.8 THEN 'medium' ELSE 'low' END AS stockout_risk,
  CASE WHEN nh >= 2 AND ba > 0 THEN round((ha - ba) / ba * 100, 1) END AS holiday_sensitivity_pct, days_covered
FROM x"""))
def i13(spark, sf):
    """Product drill-down for every item of every tenant."""
    return I.product_intelligence(sales_fact(spark, sf))


@query("i15_auto_summary", EXEC_SQL + """,
rk AS (SELECT organization_id, 0 AS ord, '$' || format('{:,.0f}', total_overstock_capital) || ' tied up in overstock' AS m FROM fin WHERE total_overstock_capital > 1000
       UNION ALL SELECT organization_id, 1, '$' || format('{:,.0f}', total_stockout_loss_risk) || ' at risk from stockouts' FROM fin WHERE total_stockout_loss_risk > 500
       UNION ALL SELECT organization_id, 2, '$' || format('{:,.0f}', total_carrying_cost) || ' annual carrying cost' FROM fin WHERE total_carrying_cost > 1000),
r3 AS (SELECT organization_id, string_agg(m, '; ' ORDER BY ord) AS risks FROM rk GROUP BY 1),
a4 AS (SELECT organization_id, string_agg(title, '; ' ORDER BY priority, seq) AS acts FROM ra GROUP BY 1)
SELECT organization_id, total_sales, growth_pct, concat_ws(' ',
  CASE WHEN growth_pct IS NOT NULL THEN 'Sales ' || CASE WHEN growth_pct >= 0 THEN 'grew' ELSE 'declined' END || ' ' || printf('%.1f', abs(growth_pct))
       || '% month-over-month (' || format('{:,.0f}', total_sales) || ' units total).' ELSE 'Total sales ' || format('{:,.0f}', total_sales) || ' units.' END,
  'Estimated revenue ' || format('{:,.0f}', revenue) || '.',
  'Inventory value ' || format('{:,.0f}', total_inventory_value) || ' with ' || format('{:,.0f}', total_overstock_capital) || ' tied up in overstock and '
    || format('{:,.0f}', total_stockout_loss_risk) || ' at stockout risk.',
  'Key risks: ' || risks || '.', 'Priority actions: ' || acts || '.') AS summary
FROM ov LEFT JOIN fin USING (organization_id) LEFT JOIN r3 USING (organization_id) LEFT JOIN a4 USING (organization_id)""")
def i15(spark, sf):
    """Management summary sentence per tenant."""
    fact, dec, fin, ov = _exec_parts(spark, sf)
    return I.auto_summary(ov, fin, I.executive_risks(fin), I.executive_actions(None, fin, ov))


@query("i16_sales_summary", with_fact(OBS_GROWTH.format(keys="organization_id") + """
SELECT f.organization_id, COUNT(DISTINCT item_id) AS total_products, COUNT(DISTINCT store_id) AS total_stores,
  COUNT(DISTINCT f.date) AS days_covered, round(SUM(f.sales), 2) AS total_sales,
  round(MAX(x.a), 2) AS avg_daily_sales, round(MAX(gg.last_sum), 2) AS last_28d_sales,
  round(MAX(gg.prior_sum), 2) AS prior_28d_sales, round(MAX(gg.growth_pct), 1) AS growth_pct
FROM fact f JOIN gg USING (organization_id)
  JOIN (SELECT organization_id, AVG(sales) AS a FROM d GROUP BY 1) x USING (organization_id)
GROUP BY f.organization_id"""))
def i16(spark, sf):
    """Snapshot sales summary per tenant."""
    return I.sales_summary(sales_fact(spark, sf))


def _questions(spark, sf):
    """User turns of ``conversations``; a conversation belongs to the tenant (region)
    whose key is its id modulo 5, as the table names none."""
    region = read_table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("_r"), F.col("r_name").alias(ORG))
    users = read_table(spark, sf, "conversations").filter(F.col("role") == "user")
    return users.join(F.broadcast(region), F.pmod(F.col("conv_id"), F.lit(5)) == F.col("_r")).select(
        ORG, F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))


@query("i17_advisor_answers")
def i17(spark, sf):
    """Rule-based answers to every user question in ``conversations`` against its
    tenant's snapshot (rows only)."""
    from tillsight.operators import alerts as A
    t = SalesTables(spark, sf)
    fact = t.fact()
    dec = H.purchase_decisions(_stats(spark, sf, tables=t))
    fin = H.financial_summary(dec)
    alerts = A.to_table_rows(A.new_alerts(A.detect_all(fact, dec), None), "2001-11-05 00:00:00")
    return I.answer_questions(_questions(spark, sf), I.sales_summary(fact), fin, dec, I.store_intelligence(fact),
                              I.product_intelligence(fact), alerts)


@query("i17_question_intents", """
SELECT r_name AS organization_id, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id,
  regexp_matches(lower(text), 'why|declin|drop|down|decreas') AS intent_decline,
  regexp_matches(lower(text), 'reorder|order|stock up|purchase|buy') AS intent_reorder,
  regexp_matches(lower(text), 'store|underperform|perform|branch|location') AS intent_stores,
  regexp_matches(lower(text), 'demand|increase|growth|trend|upcoming|popular') AS intent_demand
FROM conversations JOIN region ON r_regionkey = conv_id % 5 WHERE role = 'user'""")
def i17q(spark, sf):
    """Intents of every user question, by tenant."""
    return I.question_intents(_questions(spark, sf))


@query("d16_store_page_totals", with_fact(OBS_GROWTH.format(keys="organization_id, store_id") + """,
b AS (SELECT organization_id, store_id, SUM(sales) AS ts, SUM(sales * COALESCE(sell_price, 0)) AS rev
      FROM fact GROUP BY 1, 2)
SELECT organization_id, round(SUM(round(ts, 2)), 4) AS total_sales, round(SUM(round(rev, 2)), 4) AS total_revenue,
       round(AVG(round(growth_pct, 1)), 4) AS avg_growth_pct, COUNT(*) AS n_stores
FROM b JOIN gg USING (organization_id, store_id) GROUP BY 1"""))
def d16(spark, sf):
    """Store page totals over the store drill-down: sales, revenue, mean growth."""
    from tillsight.operators.dashboards import store_page_totals
    s = I.store_intelligence(sales_fact(spark, sf)).withColumnRenamed("revenue", "total_revenue")
    return store_page_totals(s)
