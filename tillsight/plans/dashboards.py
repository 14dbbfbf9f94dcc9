"""Registered dashboard queries (D01-D17) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.functions.calendar import season_sql
from tillsight.operators import dashboards as D
from tillsight.plans.catalog import query, r4, with_fact
from tillsight.sources.tables import sales_fact

SEASON_D = season_sql("date")


@query("d01_daily_store", with_fact(f"""
SELECT organization_id, date, store_id, {r4('SUM(sales)', 'total_sales')},
       COUNT(DISTINCT item_id) AS item_count
FROM fact GROUP BY organization_id, date, store_id"""))
def d01(spark, sf):
    """Daily sales and distinct items per tenant, date and store."""
    return D.daily_store(sales_fact(spark, sf))


@query("d02_overview", with_fact(f"""
SELECT organization_id,
       COUNT(DISTINCT item_id) AS total_products, COUNT(DISTINCT store_id) AS total_stores,
       COUNT(DISTINCT category) AS total_categories, CAST(1 AS BIGINT) AS total_states,
       {r4('SUM(sales)', 'total_sales')},
       {r4('SUM(sales) / COUNT(DISTINCT date)', 'avg_daily_sales')},
       MIN(date) AS min_date, MAX(date) AS max_date,
       COUNT(DISTINCT (item_id, store_id)) AS n_time_series,
       {r4('SUM(sales * COALESCE(sell_price, 0))', 'total_revenue')}
FROM fact GROUP BY organization_id"""))
def d02(spark, sf):
    """Headline KPIs per tenant."""
    return D.overview(sales_fact(spark, sf))


@query("d03_product_totals", with_fact(f"""
SELECT organization_id, item_id, {r4('SUM(sales)', 'total_sales')},
       COUNT(DISTINCT date) AS days_sold, COUNT(DISTINCT store_id) AS store_count
FROM fact GROUP BY organization_id, item_id"""))
def d03(spark, sf):
    """Per item totals, days sold and store count."""
    return D.product_totals(sales_fact(spark, sf))


@query("d04_top_products", with_fact(f"""
WITH p AS (SELECT organization_id, item_id, SUM(sales) AS total_sales,
              COUNT(DISTINCT date) AS days_sold, COUNT(DISTINCT store_id) AS store_count
       FROM fact GROUP BY organization_id, item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY total_sales DESC, item_id) AS rank
      FROM p)
SELECT organization_id, CAST(rank AS BIGINT) AS rank, item_id, {r4('total_sales', 'total_sales')},
       {r4('total_sales / days_sold', 'avg_daily_sales')}, store_count
FROM r WHERE rank <= 10"""))
def d04(spark, sf):
    """Top 10 items per tenant by total sales."""
    return D.top_products(sales_fact(spark, sf), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("d05_sales_trend", with_fact(f"""
WITH d AS (SELECT organization_id, date, SUM(sales) AS sales FROM fact GROUP BY organization_id, date),
r AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY date DESC) AS rn FROM d)
SELECT organization_id, date, {r4('sales', 'sales')} FROM r WHERE rn <= 90"""))
def d05(spark, sf):
    """Daily totals of the last 90 observed dates per tenant."""
    return D.sales_trend(sales_fact(spark, sf), 90)


@query("d06_store_performance", with_fact(f"""
WITH d AS (SELECT organization_id, date, store_id, SUM(sales) AS total_sales,
                  COUNT(DISTINCT item_id) AS item_count
           FROM fact GROUP BY organization_id, date, store_id)
SELECT organization_id, store_id, {r4('SUM(total_sales)', 'total_sales')},
       {r4('SUM(total_sales) / COUNT(DISTINCT date)', 'avg_daily_sales')},
       MAX(item_count) AS item_count
FROM d GROUP BY organization_id, store_id"""))
def d06(spark, sf):
    """Per store total, mean per active day, max daily distinct items."""
    return D.store_performance(sales_fact(spark, sf))


@query("d07_seasonal", with_fact(f"""
SELECT organization_id, {SEASON_D} AS season,
       {r4('SUM(sales) / COUNT(DISTINCT date)', 'avg_sales')}, {r4('SUM(sales)', 'total_sales')}
FROM fact GROUP BY organization_id, season"""))
def d07(spark, sf):
    """Sales total and per-day mean by season."""
    return D.seasonal_breakdown(sales_fact(spark, sf))


@query("d08_day_of_week", with_fact(f"""
WITH d AS (SELECT organization_id, date, store_id, SUM(sales) AS total_sales
           FROM fact GROUP BY organization_id, date, store_id),
a AS (SELECT organization_id, CAST(isodow(date) - 1 AS BIGINT) AS dow, AVG(total_sales) AS avg_sales
      FROM d GROUP BY organization_id, dow)
SELECT organization_id, dow,
       ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][dow + 1] AS day,
       {r4('avg_sales', 'avg_sales')},
       {r4('avg_sales / MAX(avg_sales) OVER (PARTITION BY organization_id) * 100', 'pct_of_peak')}
FROM a"""))
def d08(spark, sf):
    """Mean store-day total by weekday and % of the peak weekday."""
    return D.day_of_week(sales_fact(spark, sf))


@query("d09_category_sales", with_fact(f"""
SELECT organization_id, category, {r4('SUM(sales)', 'total_sales')}, {r4('AVG(sales)', 'avg_sales')},
       COUNT(*) AS n_rows
FROM fact GROUP BY organization_id, category"""))
def d09c(spark, sf):
    """Sales by category."""
    return D.breakdown(sales_fact(spark, sf), "category")


@query("d09_monthly_sales", with_fact(f"""
SELECT organization_id, CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month,
       {r4('SUM(sales)', 'total_sales')}, {r4('AVG(sales)', 'avg_sales')}, COUNT(*) AS n_rows
FROM fact GROUP BY organization_id, year, month"""))
def d09m(spark, sf):
    """Sales by year and month."""
    return D.breakdown(sales_fact(spark, sf), "month")


@query("d09_weekday_sales", with_fact(f"""
SELECT organization_id, CAST(isodow(date) - 1 AS BIGINT) AS dow,
       {r4('SUM(sales)', 'total_sales')}, {r4('AVG(sales)', 'avg_sales')}, COUNT(*) AS n_rows
FROM fact GROUP BY organization_id, dow"""))
def d09w(spark, sf):
    """Mean row sales by weekday."""
    return D.breakdown(sales_fact(spark, sf), "weekday")


@query("d09_store_sales", with_fact(f"""
SELECT organization_id, store_id, {r4('SUM(sales)', 'total_sales')}, {r4('AVG(sales)', 'avg_sales')},
       COUNT(*) AS n_rows
FROM fact GROUP BY organization_id, store_id"""))
def d09s(spark, sf):
    """Sales by store."""
    return D.breakdown(sales_fact(spark, sf), "store_id")


@query("d11_describe", with_fact(f"""
WITH long AS (
  SELECT organization_id, 'sales' AS "column", CAST(sales AS DOUBLE) AS value FROM fact
  UNION ALL
  SELECT organization_id, 'sell_price', CAST(sell_price AS DOUBLE) FROM fact)
SELECT organization_id, "column", COUNT(value) AS count,
       CAST(SUM(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count,
       {r4('AVG(value)', 'mean')}, {r4('STDDEV_SAMP(value)', 'std')}, {r4('MIN(value)', 'min')},
       {r4('quantile_cont(value, 0.25)', 'q25')}, {r4('quantile_cont(value, 0.5)', 'q50')},
       {r4('quantile_cont(value, 0.75)', 'q75')}, {r4('MAX(value)', 'max')}
FROM long GROUP BY organization_id, "column" """))
def d11(spark, sf):
    """Descriptive statistics of sales and price per tenant."""
    return D.describe(sales_fact(spark, sf), ["sales", "sell_price"])


@query("d11_value_counts", with_fact("""
SELECT organization_id, category, COUNT(*) AS count FROM fact GROUP BY organization_id, category"""))
def d11v(spark, sf):
    """Row counts per category value."""
    return D.value_counts(sales_fact(spark, sf), "category")


@query("d12_price_histogram", with_fact(f"""
WITH f AS (SELECT organization_id, sell_price FROM fact WHERE sell_price IS NOT NULL),
rng AS (SELECT organization_id, MIN(sell_price) AS lo, MAX(sell_price) AS hi FROM f GROUP BY organization_id),
b AS (SELECT f.organization_id, lo, hi,
             CAST(CASE WHEN hi = lo THEN 0
                  ELSE least(floor((sell_price - lo) / ((hi - lo) / 50)), 49) END AS BIGINT) AS bin
      FROM f JOIN rng USING (organization_id))
SELECT organization_id, bin, {r4('lo + bin * ((hi - lo) / 50)', 'bin_start')},
       {r4('lo + (bin + 1) * ((hi - lo) / 50)', 'bin_end')}, COUNT(*) AS count
FROM b GROUP BY organization_id, bin, lo, hi"""))
def d12(spark, sf):
    """50-bin price histogram per tenant."""
    return D.price_histogram(sales_fact(spark, sf), 50)


@query("d13_iqr_outliers", with_fact(f"""
WITH q AS (SELECT organization_id, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3,
                  COUNT(*) AS n_rows FROM fact GROUP BY organization_id),
f AS (SELECT f.sales, q.*, (f.sales < q1 - 1.5 * (q3 - q1) OR f.sales > q3 + 1.5 * (q3 - q1)) AS o
      FROM fact f JOIN q USING (organization_id))
SELECT organization_id, {r4('q1', 'q1')}, {r4('q3', 'q3')}, n_rows,
       COUNT(CASE WHEN o THEN 1 END) AS n_outliers,
       {r4('AVG(CASE WHEN o THEN sales END)', 'outlier_mean')},
       {r4('MIN(CASE WHEN o THEN sales END)', 'outlier_min')},
       {r4('MAX(CASE WHEN o THEN sales END)', 'outlier_max')},
       {r4('COUNT(CASE WHEN o THEN 1 END) / n_rows * 100', 'outlier_pct')}
FROM f GROUP BY organization_id, q1, q3, n_rows"""))
def d13(spark, sf):
    """1.5×IQR outliers of row sales per tenant."""
    return D.iqr_outliers(sales_fact(spark, sf))


@query("d15_hierarchy_counts", with_fact("""
SELECT organization_id, COUNT(DISTINCT item_id) AS n_items, COUNT(DISTINCT store_id) AS n_stores,
       COUNT(DISTINCT category) AS n_categories, COUNT(DISTINCT (item_id, store_id)) AS n_series,
       COUNT(DISTINCT date) AS n_days, MIN(date) AS min_date, MAX(date) AS max_date, COUNT(*) AS n_rows,
       CAST(date_diff('day', MIN(date), MAX(date)) + 1 AS BIGINT) AS calendar_days,
       CAST(date_diff('day', MIN(date), MAX(date)) + 1 - COUNT(DISTINCT date) AS BIGINT) AS missing_days
FROM fact GROUP BY organization_id"""))
def d15(spark, sf):
    """Hierarchy counts and calendar coverage per tenant."""
    return D.hierarchy_counts(sales_fact(spark, sf))


@query("d17_category_counts", with_fact("""
SELECT organization_id, category, COUNT(DISTINCT item_id) AS n_products
FROM fact GROUP BY organization_id, category"""))
def d17(spark, sf):
    """Products per category."""
    return D.category_counts(sales_fact(spark, sf))


# ----------------------------------------------------------- D10, D14, D16

from tillsight.operators.calendar import add_holiday_features  # noqa: E402
from tillsight.plans.sqlcal import holiday_ctes, tenant_years_sql  # noqa: E402


@query("d10_holiday_uplift", with_fact(f"""
WITH {tenant_years_sql('fact')}, {holiday_ctes()},
hd AS (SELECT DISTINCT organization_id, holiday_date FROM hol),
f AS (SELECT f.organization_id, f.sales, CASE WHEN h.holiday_date IS NULL THEN 0 ELSE 1 END AS ev
      FROM fact f LEFT JOIN hd h ON h.organization_id = f.organization_id AND h.holiday_date = f.date),
a AS (SELECT organization_id, AVG(CASE WHEN ev = 1 THEN sales END) AS w, AVG(CASE WHEN ev = 0 THEN sales END) AS wo
      FROM f GROUP BY 1)
SELECT organization_id, {r4('w', 'avg_with_event')}, {r4('wo', 'avg_without_event')},
       {r4('(w / wo - 1) * 100', 'uplift_pct')}
FROM a"""))
def d10(spark, sf):
    """Mean row sales on holiday (event) dates vs other dates and the uplift."""
    fact = sales_fact(spark, sf)
    return D.event_uplift(add_holiday_features(fact.select("organization_id", "date", "sales"), dates_from=fact))
