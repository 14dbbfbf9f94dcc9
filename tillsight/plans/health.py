"""Registered data-health and alert queries (J01-J13) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.functions.core import ORG
from tillsight.operators import alerts as A
from tillsight.operators import health as J
from tillsight.operators import inventory as H
from tillsight.plans.catalog import query, r4, with_fact
from tillsight.plans.inventory import SCENARIOS, STATS_STOCK, _dec_sql, _stats
from tillsight.plans.sqlcal import holiday_ctes
from tillsight.sources.tables import SalesTables, sales_fact


@query("j01_health_score", with_fact(f"""
WITH a AS (
  SELECT organization_id, COUNT(*) AS total_rows,
    CAST(SUM(CAST(item_id IS NULL AS BIGINT) + CAST(store_id IS NULL AS BIGINT) + CAST(date IS NULL AS BIGINT)
        + CAST(sales IS NULL AS BIGINT) + CAST(sell_price IS NULL AS BIGINT) + CAST(category IS NULL AS BIGINT))
      AS BIGINT) AS missing_cells,
    COUNT(*) - COUNT(DISTINCT (date, item_id, store_id)) AS duplicates,
    CAST(date_diff('day', MIN(date), MAX(date)) + 1 - COUNT(DISTINCT date) AS BIGINT) AS date_gaps,
    CAST(SUM(CAST(sales < 0 AS BIGINT)) AS BIGINT) AS negative_sales,
    quantile_cont(sell_price, 0.5) AS med, COUNT(sell_price) AS n_prices,
    MIN(date) AS min_date, MAX(date) AS max_date
  FROM fact GROUP BY organization_id),
p AS (SELECT f.organization_id, CAST(SUM(CAST(f.sell_price > a.med * 10 AS BIGINT)) AS BIGINT) AS high_prices,
             CAST(SUM(CAST(f.sell_price = 0 AS BIGINT)) AS BIGINT) AS zero_prices
      FROM fact f JOIN a USING (organization_id) GROUP BY f.organization_id),
b AS (SELECT a.*, p.high_prices, p.zero_prices, a.missing_cells / (a.total_rows * 6.0) * 100 AS missing_pct
      FROM a JOIN p USING (organization_id)),
c AS (SELECT *,
  CASE WHEN missing_pct < 1 THEN 'pass' WHEN missing_pct < 5 THEN 'warn' ELSE 'fail' END AS missing_status,
  CASE WHEN duplicates = 0 THEN 'pass' WHEN duplicates < total_rows * 0.01 THEN 'warn' ELSE 'fail' END
    AS duplicates_status,
  CASE WHEN date_gaps = 0 THEN 'pass' WHEN date_gaps < 14 THEN 'warn' ELSE 'fail' END AS coverage_status,
  CASE WHEN negative_sales = 0 THEN 'pass' ELSE 'warn' END AS negative_status,
  CASE WHEN n_prices = 0 THEN NULL WHEN zero_prices + high_prices = 0 THEN 'pass' ELSE 'warn' END AS price_status
  FROM b)
SELECT organization_id, total_rows, missing_cells, {r4('missing_pct', 'missing_pct')}, duplicates, date_gaps,
  negative_sales, zero_prices, high_prices, min_date, max_date, missing_status, duplicates_status,
  coverage_status, negative_status, price_status,
  CAST(greatest(0, least(100, 100
    - (CASE missing_status WHEN 'fail' THEN 20 WHEN 'warn' THEN 8 ELSE 0 END)
    - (CASE duplicates_status WHEN 'fail' THEN 20 WHEN 'warn' THEN 8 ELSE 0 END)
    - (CASE coverage_status WHEN 'fail' THEN 20 WHEN 'warn' THEN 8 ELSE 0 END)
    - (CASE negative_status WHEN 'fail' THEN 20 WHEN 'warn' THEN 8 ELSE 0 END)
    - (CASE price_status WHEN 'fail' THEN 20 WHEN 'warn' THEN 8 ELSE 0 END))) AS BIGINT) AS score,
  zero_prices + high_prices AS price_issues
FROM c"""))
def j01(spark, sf):
    """Data-health score and checks per tenant."""
    return J.health_score(sales_fact(spark, sf))


@query("j02_daily_anomalies", with_fact(f"""
WITH d AS (SELECT organization_id, date, SUM(sales) AS sales FROM fact GROUP BY organization_id, date),
s AS (SELECT organization_id, AVG(sales) AS m, STDDEV_SAMP(sales) AS sd, COUNT(*) AS n FROM d
      GROUP BY organization_id HAVING COUNT(*) >= 14 AND STDDEV_SAMP(sales) > 0),
z AS (SELECT d.*, s.m, (d.sales - s.m) / s.sd AS z FROM d JOIN s USING (organization_id)),
cal AS (SELECT organization_id, CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date
        FROM d GROUP BY organization_id)
SELECT organization_id, CASE WHEN z > 0 THEN 'sales_spike' ELSE 'sales_drop' END AS type, date,
       {r4('sales', 'sales')}, {r4('m', 'expected')}, round(z, 2) AS z_score,
       CASE WHEN abs(z) >= 4 THEN 'high' ELSE 'medium' END AS severity
FROM z WHERE abs(z) >= 3
UNION ALL
SELECT c.organization_id, 'missing_period', c.date, 0.0, {r4('s.m', 'expected')}, NULL, 'low'
FROM cal c JOIN s USING (organization_id)
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.organization_id = c.organization_id AND d.date = c.date)"""))
def j02(spark, sf):
    """Daily-total z-score spikes / drops and missing days per tenant."""
    return J.daily_anomalies(sales_fact(spark, sf))


@query("j03_transaction_anomalies", with_fact(f"""
SELECT organization_id, 'negative_quantity' AS type, date, item_id, store_id, {r4('sales', 'value')},
       'medium' AS severity FROM fact WHERE sales < 0
UNION ALL
SELECT organization_id, 'negative_revenue', date, item_id, store_id,
       {r4('sales * COALESCE(sell_price, 0)', 'value')}, 'medium'
FROM fact WHERE sales * COALESCE(sell_price, 0) < 0"""))
def j03(spark, sf):
    """Rows with negative quantity or revenue."""
    return J.transaction_anomalies(sales_fact(spark, sf))


def _decisions(spark, sf, tables=None):
    return H.purchase_decisions(_stats(spark, sf, tables=tables))


DEC = f"WITH dec AS ({_dec_sql(STATS_STOCK, SCENARIOS[:1])})"


@query("j05_stockout_alerts", with_fact(f"""{DEC}
SELECT organization_id, 'stockout_risk' AS alert_type,
  CASE WHEN stockout_in_days <= 3 THEN 'critical' ELSE 'high' END AS severity,
  'Stockout risk: ' || item_id || ' @ ' || store_id AS title,
  'Stock runs out in ~' || CAST(CAST(round_even(stockout_in_days, 0) AS BIGINT) AS VARCHAR) || ' days. Order '
    || CAST(CAST(round_even(recommended_order_qty, 0) AS BIGINT) AS VARCHAR) || ' units now.' AS message,
  item_id, store_id, stockout_in_days AS days
FROM dec WHERE stockout_in_days IS NOT NULL AND stockout_in_days <= 7"""))
def j05(spark, sf):
    """Stockout-risk alerts (stock runs out within the 7-day lead time)."""
    d = _decisions(spark, sf)
    a = A.stockout_alerts(d)
    ctx = F.from_json("context", "item_id string, store_id string, days string")
    return a.select(ORG, "alert_type", "severity", "title", "message", ctx.alias("c")).select(
        ORG, "alert_type", "severity", "title", "message", "c.item_id", "c.store_id",
        F.col("c.days").cast("double").alias("days"))


@query("j06_overstock_alerts", with_fact(f"""{DEC}
SELECT organization_id, 'overstock' AS alert_type, 'medium' AS severity,
  'Overstock: ' || item_id || ' @ ' || store_id AS title, item_id, store_id, days_of_stock AS days,
  overstock_capital AS capital
FROM dec WHERE days_of_stock > 90"""))
def j06(spark, sf):
    """Overstock alerts (more than 90 days of stock)."""
    a = A.overstock_alerts(_decisions(spark, sf))
    ctx = F.from_json("context", "item_id string, store_id string, days string, capital string")
    return a.select(ORG, "alert_type", "severity", "title", ctx.alias("c")).select(
        ORG, "alert_type", "severity", "title", "c.item_id", "c.store_id",
        F.col("c.days").cast("double").alias("days"), F.col("c.capital").cast("double").alias("capital"))


@query("j07_demand_change_alerts", with_fact(f"""
WITH a AS (SELECT organization_id, MAX(date) AS as_of FROM fact GROUP BY organization_id),
g AS (SELECT f.organization_id, f.item_id, f.store_id,
        COALESCE(SUM(CASE WHEN f.date > a.as_of - INTERVAL 7 DAY THEN f.sales END), 0) AS recent,
        COALESCE(SUM(CASE WHEN f.date <= a.as_of - INTERVAL 7 DAY AND f.date > a.as_of - INTERVAL 28 DAY
                          THEN f.sales END), 0) AS prior
      FROM fact f JOIN a USING (organization_id) GROUP BY f.organization_id, f.item_id, f.store_id),
c AS (SELECT *, (recent - prior) / prior * 100 AS pct FROM g WHERE prior > 0)
SELECT organization_id, CASE WHEN pct >= 40 THEN 'demand_spike' ELSE 'demand_drop' END AS alert_type,
  CASE WHEN pct >= 40 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN pct >= 40 THEN 'Demand spike: ' ELSE 'Demand drop: ' END || item_id || ' @ ' || store_id AS title,
  CASE WHEN pct >= 40 THEN 'Sales up ' || CAST(CAST(round_even(pct, 0) AS BIGINT) AS VARCHAR)
       || '% in the last 7 days. Consider stocking up.'
       ELSE 'Sales down ' || CAST(CAST(round_even(abs(pct), 0) AS BIGINT) AS VARCHAR) || '% in the last 7 days.'
  END AS message,
  item_id, store_id, round(pct, 1) AS change_pct
FROM c WHERE pct >= 40 OR pct <= -40"""))
def j07(spark, sf):
    """Demand spike / drop alerts per series (last 7 days vs the 21 before)."""
    a = A.demand_change_alerts(sales_fact(spark, sf))
    ctx = F.from_json("context", "change_pct string, item_id string, store_id string")
    return a.select(ORG, "alert_type", "severity", "title", "message", ctx.alias("c")).select(
        ORG, "alert_type", "severity", "title", "message", "c.item_id", "c.store_id",
        F.col("c.change_pct").cast("double").alias("change_pct"))


J09_SQL = with_fact(f"""
WITH sdates AS (SELECT DISTINCT organization_id, CAST(date + INTERVAL 28 YEAR AS DATE) AS as_of FROM fact),
yrs AS (SELECT DISTINCT organization_id, unnest([year(as_of), year(as_of) + 1]) AS year FROM sdates),
{holiday_ctes()},
up AS (
  SELECT d.organization_id, d.as_of, h.name, h.holiday_date, date_diff('day', d.as_of, h.holiday_date) AS du
  FROM sdates d JOIN hol h ON h.organization_id = d.organization_id AND h.holiday_date >= d.as_of
   AND h.table_year IN (year(d.as_of), year(d.as_of) + 1)
  QUALIFY row_number() OVER (PARTITION BY d.organization_id, d.as_of
                             ORDER BY h.holiday_date, h.table_year, h.name) <= 10),
ctx AS (SELECT *, '{{"date":"' || CAST(holiday_date AS VARCHAR) || '","days_until":"' || CAST(du AS VARCHAR)
                  || '","holiday":"' || name || '"}}' AS context FROM up WHERE du BETWEEN 0 AND 7)
SELECT organization_id, 'upcoming_holiday' AS alert_type, 'info' AS severity, 'Upcoming holiday: ' || name AS title,
       name || ' is in ' || CAST(du AS VARCHAR) || ' days. Stock up early.' AS message, context,
       organization_id || ':upcoming_holiday:' || context AS dedup_key
FROM ctx""")


@query("j09_holiday_alerts_shifted", J09_SQL)
def j09(spark, sf):
    """Upcoming-holiday alerts within 7 days of every shifted sales date."""
    f = sales_fact(spark, sf).withColumn("date", F.add_months("date", 336))
    dates = f.select(ORG, F.col("date").alias("as_of")).distinct()
    return A.holiday_alerts(dates)


@query("j10_store_anomalies", with_fact(f"""
WITH a AS (SELECT organization_id, MAX(date) AS as_of FROM fact GROUP BY organization_id),
d AS (SELECT organization_id, store_id, date, SUM(sales) AS sales FROM fact GROUP BY organization_id, store_id, date),
g AS (SELECT d.organization_id, d.store_id,
        AVG(CASE WHEN d.date > a.as_of - INTERVAL 7 DAY THEN sales END) AS recent_mean,
        AVG(CASE WHEN d.date <= a.as_of - INTERVAL 7 DAY THEN sales END) AS hist_mean,
        STDDEV_SAMP(CASE WHEN d.date <= a.as_of - INTERVAL 7 DAY THEN sales END) AS hist_std,
        COUNT(CASE WHEN d.date <= a.as_of - INTERVAL 7 DAY THEN 1 END) AS hist_days
      FROM d JOIN a USING (organization_id) GROUP BY d.organization_id, d.store_id)
SELECT organization_id, store_id, {r4('recent_mean', 'recent_mean')}, {r4('hist_mean', 'hist_mean')},
       {r4('hist_std', 'hist_std')}, hist_days, {r4('(recent_mean - hist_mean) / hist_std', 'z_score')}
FROM g WHERE hist_days >= 14 AND hist_std > 0"""))
def j10(spark, sf):
    """Per-store z-score of the last 7 days vs its own history (J10 numbers)."""
    return A.store_zscores(sales_fact(spark, sf))


ALERTS_SQL = with_fact(f"""{DEC},
t_asof AS (SELECT organization_id, MAX(date) AS as_of FROM fact GROUP BY organization_id),
chg AS (
  SELECT f.organization_id, f.item_id, f.store_id,
    COALESCE(SUM(CASE WHEN f.date > a.as_of - INTERVAL 7 DAY THEN f.sales END), 0) AS recent,
    COALESCE(SUM(CASE WHEN f.date <= a.as_of - INTERVAL 7 DAY AND f.date > a.as_of - INTERVAL 28 DAY
                      THEN f.sales END), 0) AS prior
  FROM fact f JOIN t_asof a USING (organization_id) GROUP BY 1, 2, 3),
sd AS (SELECT organization_id, store_id, date, SUM(sales) AS sales FROM fact GROUP BY 1, 2, 3),
sz AS (
  SELECT d.organization_id, d.store_id,
    AVG(CASE WHEN d.date > a.as_of - INTERVAL 7 DAY THEN sales END) AS rm,
    AVG(CASE WHEN d.date <= a.as_of - INTERVAL 7 DAY THEN sales END) AS hm,
    STDDEV_SAMP(CASE WHEN d.date <= a.as_of - INTERVAL 7 DAY THEN sales END) AS hs,
    COUNT(CASE WHEN d.date <= a.as_of - INTERVAL 7 DAY THEN 1 END) AS hn
  FROM sd d JOIN t_asof a USING (organization_id) GROUP BY 1, 2),
yrs AS (SELECT organization_id, unnest([year(as_of), year(as_of) + 1]) AS year FROM t_asof),
{holiday_ctes()},
up AS (
  SELECT a.organization_id, date_diff('day', a.as_of, h.holiday_date) AS du
  FROM t_asof a JOIN hol h ON h.organization_id = a.organization_id AND h.holiday_date >= a.as_of
  QUALIFY row_number() OVER (PARTITION BY a.organization_id ORDER BY h.holiday_date, h.table_year, h.name) <= 10),
al AS (
  SELECT organization_id, 'stockout_risk' AS alert_type, CASE WHEN stockout_in_days <= 3 THEN 'critical' ELSE 'high' END AS severity FROM dec
    WHERE stockout_in_days IS NOT NULL AND stockout_in_days <= 7
  UNION ALL SELECT organization_id, 'overstock', 'medium' FROM dec WHERE days_of_stock > 90
  UNION ALL SELECT organization_id, CASE WHEN (recent - prior) / prior * 100 >= 40 THEN 'demand_spike'
                                         ELSE 'demand_drop' END,
         CASE WHEN (recent - prior) / prior * 100 >= 40 THEN 'high' ELSE 'medium' END
    FROM chg WHERE prior > 0 AND abs((recent - prior) / prior * 100) >= 40
  UNION ALL SELECT organization_id, 'store_performance', CASE WHEN abs((rm - hm) / hs) > 3 THEN 'high' ELSE 'medium' END FROM sz WHERE hn >= 14 AND hs > 0 AND abs((rm - hm) / hs) > 2
  UNION ALL SELECT organization_id, 'upcoming_holiday', 'info' FROM up WHERE du BETWEEN 0 AND 7)
""")

J12_SQL = ALERTS_SQL + "SELECT organization_id, alert_type, COUNT(*) AS n_alerts FROM al GROUP BY 1, 2"
J13_SQL = ALERTS_SQL + """
SELECT organization_id, COUNT(*) AS open, COUNT(*) AS unread,
  COUNT(CASE WHEN severity = 'critical' THEN 1 END) AS critical, COUNT(CASE WHEN severity = 'high' THEN 1 END) AS high,
  COUNT(CASE WHEN severity = 'medium' THEN 1 END) AS medium, COUNT(CASE WHEN severity = 'low' THEN 1 END) AS low,
  COUNT(CASE WHEN severity = 'info' THEN 1 END) AS info
FROM al GROUP BY 1"""


@query("j12_alert_counts", J12_SQL)
def j12(spark, sf):
    """All detectors for all tenants, deduped, counted by type (rows only)."""
    t = SalesTables(spark, sf)
    alerts = A.new_alerts(A.detect_all(t.fact(), _decisions(spark, sf, t)), None)
    return A.counts_by_type(alerts)


@query("j13_alert_summary", J13_SQL)
def j13(spark, sf):
    """Open / unread / per-severity counts over a freshly detected alert table."""
    t = SalesTables(spark, sf)
    table = A.to_table_rows(A.new_alerts(A.detect_all(t.fact(), _decisions(spark, sf, t)), None),
                            "2001-11-05 00:00:00")
    return A.alert_counts(table)

