"""Registered queries of the weather table, the wide files, alert maintenance, report
lists and small options, over frames that Spark derives from the given tables.

* Weather: one row per order, as 3-hourly measurements at the order's day.
* Wide files: sales by day of the month (``d_1`` ... ``d_31``) per item (brand) and
  store (nation) of the fact, a calendar of these days and weekly prices,
  written as CSV and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillsight.functions.core import ORG, finite_all
from tillsight.operators import alerts as A
from tillsight.operators import calendar as K
from tillsight.operators import dashboards as D
from tillsight.operators import features as E
from tillsight.operators import health as J
from tillsight.operators import insights as INS
from tillsight.operators import inventory as H
from tillsight.operators import models as G
from tillsight.plans.catalog import query, r4, with_fact
from tillsight.plans.health import DEC, J12_SQL, _decisions
from tillsight.plans.ingest import PUSHED_SQL, TENANT, pushed_rows
from tillsight.plans.inventory import _stats
from tillsight.plans.lifecycle import INGEST_SQL, _ingested
from tillsight.session import scratch_path
from tillsight.sources import ingest as I
from tillsight.sources.tables import SalesTables, materialize, read_table, sales_fact

# ------------------------------------------------------------- weather


def _three_hourly(spark, sf):
    o = read_table(spark, sf, "orders")
    t = (F.col("o_custkey") % 45 - 3).cast("double")
    return o.select(F.col("o_orderdate").alias("datetime"), t.alias("temperature_c"), (t - 1).alias("feels_like_c"),
                    (t - 2).alias("temp_min_c"), (t + 2).alias("temp_max_c"), (F.col("o_custkey") % 101).cast("double").alias("humidity_pct"),
                    (F.col("o_orderkey") % 30 + 1000).cast("double").alias("pressure_hpa"),
                    (F.col("o_orderkey") % 12).cast("double").alias("wind_speed_ms"), (F.col("o_orderkey") % 7).cast("double").alias("rain_3h_mm"),
                    F.col("o_orderstatus").alias("weather_condition"), F.col("o_orderpriority").alias("weather_description"))


WEATHER_SQL = """
w3 AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 45 - 3 AS DOUBLE) AS t, CAST(o_custkey % 101 AS DOUBLE) AS h,
              o_orderkey AS k, o_orderstatus AS c, o_orderpriority AS p FROM orders),
mode_c AS (SELECT date, arg_min(c, (-n, c)) AS c FROM (SELECT date, c, COUNT(*) AS n FROM w3 GROUP BY 1, 2) GROUP BY 1),
mode_p AS (SELECT date, arg_min(p, (-n, p)) AS p FROM (SELECT date, p, COUNT(*) AS n FROM w3 GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT date, AVG(t) AS temp_c, AVG(t - 1) AS feels_like_c, MIN(t - 2) AS temp_min_c, MAX(t + 2) AS temp_max_c, AVG(h) AS humidity_pct,
             AVG(k % 30 + 1000) AS pressure_hpa, CAST(MAX(k % 12) AS DOUBLE) AS wind_speed_ms, CAST(SUM(k % 7) AS DOUBLE) AS rain_mm
      FROM w3 GROUP BY 1)"""


@query("f11_daily_weather", f"""WITH {WEATHER_SQL}
SELECT date, {r4('temp_c', 'temp_c')}, {r4('feels_like_c', 'feels_like_c')}, temp_min_c, temp_max_c, {r4('humidity_pct', 'humidity_pct')},
  {r4('pressure_hpa', 'pressure_hpa')}, wind_speed_ms, rain_mm, c AS weather_condition, p AS weather_description
FROM w JOIN mode_c USING (date) JOIN mode_p USING (date)""")
def f11(spark, sf):
    """3-hourly measurements to daily means, extremes, sums and modes."""
    return K.daily_weather(_three_hourly(spark, sf)).drop("season")


@query("e04_weather_table_features", with_fact(f"""WITH {WEATHER_SQL},
d AS (SELECT DISTINCT organization_id, date FROM fact)
SELECT organization_id, date, {r4('temp_c', 'temp_c')}, {r4('humidity_pct', 'humidity_pct')}, rain_mm,
  CAST(temp_c >= 35 AS BIGINT) AS is_extreme_heat, CAST(temp_c <= 10 AS BIGINT) AS is_cold_wave,
  CAST(temp_c BETWEEN 20 AND 30 AS BIGINT) AS is_comfortable_temp, CAST(humidity_pct >= 70 AS BIGINT) AS is_high_humidity,
  CAST(humidity_pct <= 30 AS BIGINT) AS is_low_humidity, CAST(rain_mm > 5 AS BIGINT) AS is_rainy, CAST(rain_mm > 20 AS BIGINT) AS is_heavy_rain
FROM d LEFT JOIN w USING (date)"""))
def e04w(spark, sf):
    """Weather columns and flags of every sales date from a weather table (C04, C07): NULL where it has no row."""
    w = K.daily_weather(_three_hourly(spark, sf)).select("date", "temp_c", "humidity_pct", "rain_mm")
    return E.weather_features(sales_fact(spark, sf).select(ORG, "date").distinct(), weather=w)


@query("e02b_season_features_short", with_fact(f"""
WITH d AS (SELECT DISTINCT organization_id, date FROM fact)
SELECT organization_id, date, {r4('sin(2 * pi() * month(date) / 12)', 'month_sin')}, {r4('cos(2 * pi() * month(date) / 12)', 'month_cos')},
  {r4('sin(2 * pi() * (isodow(date) - 1) / 7)', 'dow_sin')}, {r4('cos(2 * pi() * (isodow(date) - 1) / 7)', 'dow_cos')} FROM d"""))
def e02b(spark, sf):
    """Cyclic terms without those of the day of the year."""
    f = E.season_features(sales_fact(spark, sf).select(ORG, "date").distinct(), with_doy=False)
    assert "doy_sin" not in f.columns
    return f.select(ORG, "date", "month_sin", "month_cos", "dow_sin", "dow_cos")


# ------------------------------------------------------------- wide files


def _wide_files(spark, sf) -> str:
    """Sales, calendar and prices as CSV files in a scratch folder."""
    root = scratch_path(spark, f"wide-{uuid.uuid4().hex}")
    f = sales_fact(spark, sf).withColumn("item", F.substring_index("item_id", "/", 1)).withColumn("k", F.dayofmonth("date"))
    sums = f.groupBy("item", "store_id", ORG).pivot("k", list(range(1, 32))).agg(F.sum("sales"))
    wide = sums.select(F.col("item").alias("item_id"), F.substring("item", 1, 6).alias("dept_id"), F.lit("ALL").alias("cat_id"), "store_id",
                       F.col(ORG).alias("state_id"), *[F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"d_{k}") for k in range(1, 32)])
    wide.write.option("header", True).csv(f"{root}/sales")
    days = f.select("k").distinct().select(
        F.format_string("2000-01-%02d", "k").alias("date"), (F.lit(200001) + F.floor((F.col("k") - 1) / 7)).cast("string").alias("wm_yr_wk"),
        F.concat(F.lit(" d_"), F.col("k").cast("string"), F.lit(" ")).alias("d"), F.when(F.col("k") == 1, "Payday").alias("event_name_1"))
    days.write.option("header", True).csv(f"{root}/calendar")
    prices = f.where("k < 29").groupBy("store_id", F.col("item").alias("item_id"), (F.lit(200001) + F.floor((F.col("k") - 1) / 7)).alias("wm_yr_wk"))
    prices.agg(F.max("sell_price").alias("sell_price")).write.option("header", True).csv(f"{root}/prices")
    return root


WIDE_SQL = """
x AS (SELECT organization_id AS state_id, split_part(item_id, '/', 1) AS item_id, store_id, day(date) AS k, sales, sell_price FROM fact),
ser AS (SELECT DISTINCT state_id, item_id, store_id FROM x),
long AS (SELECT ser.*, k, coalesce(s, 0) AS sales FROM ser CROSS JOIN range(1, 32) t(k)
         LEFT JOIN (SELECT state_id, item_id, store_id, k, SUM(sales) AS s FROM x GROUP BY 1, 2, 3, 4) USING (state_id, item_id, store_id, k)),
pr AS (SELECT store_id, item_id, (k - 1) // 7 AS wk, MAX(sell_price) AS sell_price FROM x WHERE k < 29 GROUP BY 1, 2, 3)"""


@query("b10_melted_sales", with_fact(f"""WITH {WIDE_SQL}
SELECT item_id, left(item_id, 6) AS dept_id, 'ALL' AS cat_id, store_id, state_id, 'd_' || CAST(k AS VARCHAR) AS d, round(sales, 4) AS sales FROM long"""))
def b10(spark, sf):
    """Wide sales file read (A01) and melted to one row per day column."""
    return I.melt_sales(I.read_wide_sales(spark, f"{_wide_files(spark, sf)}/sales"))


@query("b12_base_frame", with_fact(f"""WITH {WIDE_SQL}
SELECT item_id, store_id, state_id, 'd_' || CAST(k AS VARCHAR) AS d, CAST('2000-01-01' AS DATE) + CAST(k - 1 AS INTEGER) AS date,
  CAST(200001 + (k - 1) // 7 AS BIGINT) AS wm_yr_wk, CASE WHEN k = 1 THEN 'Payday' ELSE 'None' END AS event_name_1,
  round(long.sales, 4) AS sales, round(pr.sell_price, 4) AS sell_price
FROM long LEFT JOIN pr USING (store_id, item_id) WHERE coalesce(pr.wk, (k - 1) // 7) = (k - 1) // 7 AND pr.wk IS NOT NULL AND long.sales > 0
UNION ALL
SELECT item_id, store_id, state_id, 'd_' || CAST(k AS VARCHAR), CAST('2000-01-01' AS DATE) + CAST(k - 1 AS INTEGER),
  CAST(200001 + (k - 1) // 7 AS BIGINT), CASE WHEN k = 1 THEN 'Payday' ELSE 'None' END, round(long.sales, 4), NULL
FROM long WHERE long.sales > 0 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.store_id = long.store_id AND pr.item_id = long.item_id
  AND pr.wk = (long.k - 1) // 7)"""))
def b12(spark, sf):
    """Wide sales, calendar and prices (A01, A02) to the base frame: B09-B12, C03."""
    root = _wide_files(spark, sf)
    base = I.build_base(I.read_wide_sales(spark, f"{root}/sales"), I.read_calendar(spark, f"{root}/calendar"), I.read_prices(spark, f"{root}/prices"))
    return base.select("item_id", "store_id", "state_id", "d", "date", "wm_yr_wk", "event_name_1", "sales", "sell_price")


@query("b13_filled_prices", with_fact(f"""WITH {WIDE_SQL},
b AS (SELECT long.*, pr.sell_price FROM long LEFT JOIN pr ON pr.store_id = long.store_id AND pr.item_id = long.item_id AND pr.wk = (long.k - 1) // 7
      WHERE long.sales > 0)
SELECT state_id, COUNT(*) AS rows, COUNT(CASE WHEN sell_price IS NULL THEN 1 END) AS filled, COUNT(sell_price) AS complete,
  {r4('SUM(coalesce(sell_price, 0))', 'price_sum')} FROM b GROUP BY 1"""))
def b13(spark, sf):
    """Missing prices of the base frame filled with 0, or their rows dropped, counted per state."""
    base = materialize(b12(spark, sf), "wide-base")
    filled = I.fill_and_drop(base).groupBy("state_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("sell_price") == 0, 1)).alias("filled"), F.sum("sell_price").alias("price_sum"))
    whole = I.fill_and_drop(base, fill=False).groupBy("state_id").agg(F.count(F.lit(1)).alias("complete"))
    return filled.join(whole, "state_id").select("state_id", "rows", "filled", "complete", "price_sum")


# ------------------------------------------------------------- ingest options


@query("b03_auto_clean", PUSHED_SQL + """
SELECT date, item_id, 'STORE_001' AS store_id, COUNT(*) AS rows, CAST(bool_and(s >= 0) AS BOOLEAN) AS clipped FROM (
  SELECT date, item_id, max(sales) AS s FROM e GROUP BY date, item_id) GROUP BY 1, 2""")
def b03(spark, sf):
    """Upload clean-up alone: one row per date, item and default store, sales never negative."""
    c = I.auto_clean(pushed_rows(spark, sf).drop("_ts", "event_id"))
    return c.groupBy("date", "item_id", "store_id").agg(F.count(F.lit(1)).alias("rows"), (F.min("sales") >= 0).alias("clipped"))


@query("b15_encoded_items", with_fact("""
WITH n AS (SELECT item_id, COUNT(*) AS n FROM fact GROUP BY 1)
SELECT item_id, CAST(row_number() OVER (ORDER BY n DESC, item_id) - 1 AS DOUBLE) AS item_id_idx FROM n"""))
def b15(spark, sf):
    """Item ids as indices by falling frequency."""
    return I.encode_ids(sales_fact(spark, sf).select("item_id"), ["item_id"]).distinct()


@query("b17_date_range", f"""WITH {INGEST_SQL}
SELECT 'acme' AS organization_id, item_id, store_id, date, round(sales, 4) AS sales FROM c WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'""")
def b17(spark, sf):
    """Ingested sales of one tenant between two dates, both included."""
    root, _ = _ingested(spark, sf)
    return I.load_sales(spark, root, "1997-01-01", "1998-06-30", "acme").select(ORG, "item_id", "store_id", "date", "sales")


@query("g08_holdout_split", with_fact("""
WITH mx AS (SELECT organization_id, MAX(date) AS mx FROM fact GROUP BY 1)
SELECT organization_id, CASE WHEN date > mx - INTERVAL 28 DAY THEN 'test' ELSE 'train' END AS part, COUNT(*) AS rows, MIN(date) AS first_date,
  MAX(date) AS last_date FROM fact JOIN mx USING (organization_id) GROUP BY 1, 2"""))
def g08(spark, sf):
    """Rows and dates of the last 28 days and of what lies before, per tenant."""
    train, test = G.holdout_split(sales_fact(spark, sf), 28)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy(ORG, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# ------------------------------------------------------------- dashboards, health, alerts


@query("d09_top20_products", with_fact("""
WITH p AS (SELECT organization_id, item_id, SUM(sales) AS s FROM fact GROUP BY 1, 2)
SELECT organization_id, item_id, round(s, 4) AS total_sales FROM p
QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY s DESC, item_id) <= 20"""))
def d09p(spark, sf):
    """The 20 best selling items per tenant."""
    return D.top_products(sales_fact(spark, sf), 20).select(ORG, "item_id", "total_sales")


@query("l02_calendar_gaps", with_fact("""
WITH r AS (SELECT organization_id, MIN(date) AS lo, MAX(date) AS hi FROM fact GROUP BY 1),
c AS (SELECT organization_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM r)
SELECT organization_id, date FROM c ANTI JOIN fact USING (organization_id, date)"""))
def l02(spark, sf):
    """Days between a tenant's first and last date without any sale."""
    return J.calendar_gaps(J.daily_totals(sales_fact(spark, sf)))


@query("j03_returns", """
WITH r AS (SELECT 'acme' AS organization_id, CAST(l_shipdate AS DATE) AS date, 'P' || CAST(l_partkey AS VARCHAR) AS item_id,
             'S' || CAST(l_suppkey AS VARCHAR) AS store_id, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS sales,
             CASE WHEN l_linestatus = 'O' THEN -1.0 ELSE 2.0 END AS sell_price FROM lineitem)
SELECT organization_id, 'negative_quantity' AS type, date, item_id, store_id, round(sales, 4) AS value, 'medium' AS severity FROM r WHERE sales < 0
UNION ALL SELECT organization_id, 'negative_revenue', date, item_id, store_id, round(sales * sell_price, 4), 'medium' FROM r WHERE sales * sell_price < 0""")
def j03r(spark, sf):
    """Negative quantities and revenues among all lineitem rows, returned ones taken as negative."""
    li = read_table(spark, sf, "lineitem")
    rows = li.select(F.lit("acme").alias(ORG), F.to_date("l_shipdate").alias("date"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("item_id"),
                     F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("store_id"),
                     F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("sales"),
                     F.when(F.col("l_linestatus") == "O", -1.0).otherwise(2.0).alias("sell_price"))
    return J.transaction_anomalies(rows)


@query("j07_scaled_changes", with_fact(f"""
WITH t AS (SELECT organization_id, MAX(date) AS as_of FROM fact GROUP BY 1),
c AS (SELECT f.organization_id, item_id, store_id, COALESCE(SUM(CASE WHEN date > as_of - INTERVAL 7 DAY THEN sales END), 0) AS recent,
        COALESCE(SUM(CASE WHEN date <= as_of - INTERVAL 7 DAY AND date > as_of - INTERVAL 28 DAY THEN sales END), 0) / 3 AS prior
      FROM fact f JOIN t USING (organization_id) GROUP BY 1, 2, 3)
SELECT organization_id, item_id, store_id, {r4('recent', 'recent_sales')}, {r4('prior', 'prior_sales')}, {r4('(recent - prior) / prior * 100', 'change_pct')}
FROM c WHERE prior > 0"""))
def j07s(spark, sf):
    """Demand change of each series against a week's share of the three weeks before."""
    return A.demand_changes(sales_fact(spark, sf), scaled=True).select(ORG, "item_id", "store_id", "recent_sales", "prior_sales", "change_pct")


def _all_alerts(spark, sf):
    t = SalesTables(spark, sf)
    return materialize(A.new_alerts(A.detect_all(t.fact(), _decisions(spark, sf, t)), None), "alerts")


@query("j11_new_alerts", f"SELECT * FROM ({J12_SQL}) WHERE alert_type NOT IN ('overstock', 'demand_drop')")
def j11(spark, sf):
    """Alerts that are not open yet, by type: overstock ones are, demand drops are too, but some of them resolved and raised again."""
    alerts = _all_alerts(spark, sf)
    table = A.to_table_rows(alerts.where("alert_type IN ('overstock', 'demand_drop')"), "2001-11-05 00:00:00")
    return A.counts_by_type(A.new_alerts(alerts, table))


@query("j14_marked_alerts", f"""
SELECT organization_id, CAST(SUM(CASE WHEN alert_type <> 'demand_drop' THEN n_alerts ELSE 0 END) AS BIGINT) AS open,
  CAST(SUM(CASE WHEN alert_type NOT IN ('demand_drop', 'overstock') THEN n_alerts ELSE 0 END) AS BIGINT) AS unread FROM ({J12_SQL}) GROUP BY 1""")
def j14(spark, sf):
    """Open and unread counts after all demand drops were resolved and all overstock alerts read."""
    alerts = _all_alerts(spark, sf)
    table = A.to_table_rows(alerts, "2001-11-05 00:00:00")
    table = A.mark(table, alerts.where("alert_type = 'demand_drop'"), read=True, resolve=True, at="2001-11-06 00:00:00")
    table = A.mark(table, alerts.where("alert_type = 'overstock'"), read=True)
    return A.alert_counts(table).select(ORG, "open", "unread")


@query("m05_alerts_by_batches", J12_SQL)
def m05(spark, sf):
    """Alert table after the same alerts arrived in two stream batches: each is stored once."""
    from tillsight.streaming import ingest as M
    root = scratch_path(spark, f"alerts-{uuid.uuid4().hex}")
    alerts = _all_alerts(spark, sf)
    for k in (1, 2):
        alerts.write.parquet(f"{root}/in/{k}")
        stream = spark.readStream.schema(alerts.schema).parquet(f"{root}/in/{k}")
        M.alert_stream(stream, f"{root}/alerts", f"{root}/_ckpt{k}").awaitTermination()
    return A.counts_by_type(spark.read.parquet(f"{root}/alerts"))


# ------------------------------------------------------------- report lists


@query("i14_report_decisions", with_fact(f"""{DEC}
SELECT organization_id, item_id, store_id, round(recommended_order_qty, 4) AS recommended_order_qty, status, inventory_value, overstock_capital,
  stockout_revenue_loss, CAST(row_number() OVER (PARTITION BY organization_id ORDER BY recommended_order_qty DESC, item_id, store_id) AS BIGINT) AS rank
FROM dec"""))
def i14(spark, sf):
    """Decisions of the report payload, largest orders first."""
    t = SalesTables(spark, sf)
    dec = H.purchase_decisions(_stats(spark, sf, tables=t))
    rep = INS.report_payload(t.fact(), dec, H.financial_summary(dec))
    return rep["decisions"].select(ORG, "item_id", "store_id", "recommended_order_qty", "status", "inventory_value", "overstock_capital",
                                   "stockout_revenue_loss", "rank")


@query("i16_snapshot_lists", with_fact(f"""{DEC},
o AS (SELECT organization_id, item_id, store_id, row_number() OVER (PARTITION BY organization_id ORDER BY recommended_order_qty DESC, item_id, store_id) AS r FROM dec),
s AS (SELECT organization_id, item_id, store_id, row_number() OVER (PARTITION BY organization_id ORDER BY stockout_in_days, item_id, store_id) AS r
      FROM dec WHERE stockout_in_days IS NOT NULL)
SELECT organization_id, 'top_reorder_items' AS list, item_id, store_id, CAST(r AS BIGINT) AS rank FROM o WHERE r <= 12
UNION ALL SELECT organization_id, 'stockout_risks', item_id, store_id, CAST(r AS BIGINT) FROM s WHERE r <= 12"""))
def i16l(spark, sf):
    """Reorder and stockout lists of the snapshot, the first twelve of each as asked for."""
    t = SalesTables(spark, sf)
    fact, dec = t.fact(), H.purchase_decisions(_stats(spark, sf, tables=t))
    snap = INS.business_snapshot(fact, dec, H.financial_summary(dec), INS.store_intelligence(fact), INS.product_intelligence(fact), top_k=12)
    parts = [snap[n].select(ORG, F.lit(n).alias("list"), "item_id", "store_id", "rank") for n in ("top_reorder_items", "stockout_risks")]
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------- small sources, sinks, samples


@query("a05_json_rows", """
SELECT l_orderkey AS order_id, l_partkey AS part, round(l_quantity, 4) AS qty, CAST(l_shipdate AS DATE) AS shipped,
       CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem""")
def a05(spark, sf):
    """Line items written as JSON lines and read back under a schema (a missing field is NULL)."""
    path = scratch_path(spark, f"json-{uuid.uuid4().hex}")
    rows = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"),
        F.to_date("l_shipdate").alias("shipped"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_returnflag")).alias("flag"))
    rows.write.mode("overwrite").json(path)
    return I.read_rows_json(spark, path, "order_id long, part long, qty double, shipped date, flag string")


@query("a13_upload_history", """
SELECT 'ann' AS user_id, 'lineitem.csv' AS filename, 'processed' AS status, COUNT(*) AS rows, CAST(NULL AS VARCHAR) AS error FROM lineitem
UNION ALL SELECT 'ann', 'orders.csv', 'failed', COUNT(*), 'no date column' FROM orders""")
def a13(spark, sf):
    """One user's uploads of three tables' rows, recorded in the dataset catalogue (successes and an error)."""
    root = scratch_path(spark, f"datasets-{uuid.uuid4().hex}")
    for user, name, status, error in (("ann", "lineitem", "processed", None), ("bob", "part", "processed", None), ("ann", "orders", "failed", "no date column")):
        I.record_dataset(spark, root, "acme", user, f"{name}.csv", status, read_table(spark, sf, name).count(), error)
    return I.upload_history(spark.read.parquet(f"{root}/datasets"), "ann").select("user_id", "filename", "status", "rows", "error")


@query("a15_decision_report", with_fact(f"""{DEC}
SELECT organization_id, item_id, store_id, round(recommended_order_qty, 4) AS recommended_order_qty, order_date, arrival_date, status,
  round(days_of_stock, 4) AS days_of_stock, stockout_date, round(unit_price, 4) AS unit_price, round(inventory_value, 4) AS inventory_value,
  round(overstock_capital, 4) AS overstock_capital, round(stockout_revenue_loss, 4) AS stockout_revenue_loss, round(potential_savings, 4) AS potential_savings
FROM dec"""))
def a15(spark, sf):
    """The decision report's CSV files (thirteen columns), read back."""
    path = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    I.write_decision_report(H.purchase_decisions(_stats(spark, sf)), path)
    kinds = {"order_date": "date", "arrival_date": "date", "stockout_date": "date"} | {c: "double" for c in (
        "recommended_order_qty", "days_of_stock", "unit_price", "inventory_value", "overstock_capital", "stockout_revenue_loss", "potential_savings")}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in I.REPORT_DECISION_COLUMNS)
    back = spark.read.schema(f"{schema}, {ORG} string").option("header", True).csv(path)
    return back.select(ORG, *I.REPORT_DECISION_COLUMNS)


@query("b16_finite_frame", with_fact("""
SELECT organization_id, item_id, store_id, date, round(CASE WHEN day(date) > 2 THEN sales END, 4) AS sales, round(sell_price, 4) AS sell_price FROM fact"""))
def b16(spark, sf):
    """A frame with NaN and infinite sales on the first days of each month: they become NULL."""
    bad = F.when(F.dayofmonth("date") == 1, F.lit(float("nan"))).when(F.dayofmonth("date") == 2, F.lit(float("-inf"))).otherwise(F.col("sales"))
    return finite_all(sales_fact(spark, sf).withColumn("sales", bad)).drop("category")


@query("b18_sampled_series", with_fact("""
WITH s AS (SELECT organization_id, COUNT(DISTINCT item_id || '|' || store_id) AS n FROM fact GROUP BY 1)
SELECT organization_id, least(n, 20) AS series, true AS whole FROM s"""))
def b18(spark, sf):
    """Twenty series of each tenant by seeded hash: their number, and whether each kept all its rows (C13 restricts by the same join)."""
    fact = sales_fact(spark, sf)
    kept = I.sample_series(fact, 20).groupBy(*G.SERIES).agg(F.count(F.lit(1)).alias("kept"))
    rows = fact.groupBy(*G.SERIES).agg(F.count(F.lit(1)).alias("rows"))
    return kept.join(rows, G.SERIES).groupBy(ORG).agg(F.count(F.lit(1)).alias("series"), F.bool_and(F.col("kept") == F.col("rows")).alias("whole"))


@query("b19_sampled_rows", with_fact("""
SELECT organization_id, least(COUNT(*), 1500) AS rows, least(COUNT(*), 1500) AS distinct_rows FROM fact GROUP BY 1"""))
def b19(spark, sf):
    """Exactly 1,500 rows of each tenant (all, if fewer) by seeded hash: their number, and that none is repeated."""
    kept = I.sample_n_rows(sales_fact(spark, sf), 1500)
    per_key = kept.groupBy(ORG, "item_id", "store_id", "date").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(ORG).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
