"""Registered ingest queries (A/B operators) over pushed rows derived from ``events``.

``events`` purchase rows play the part of pushed sales rows: ``ts`` arrives
as an upload column called ``timestamp`` (an accepted date alias), ``value``
as ``qty`` and the ``props`` key as ``sku``; there is no store or price
column, so the default store and the zero-row skip rule apply.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillsight.functions.core import ORG
from tillsight.plans.catalog import query
from tillsight.session import scratch_path
from tillsight.sources import ingest as A
from tillsight.sources.tables import read_table

TENANT = "events"

PUSHED_SQL = """
WITH e AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS date, greatest(COALESCE(value, 0.0), 0.0) AS sales,
         'SKU' || json_extract_string(props, '$.k') AS item_id
  FROM events WHERE event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY date, item_id ORDER BY ts, event_id) AS rn FROM e),
clean AS (SELECT 'events' AS organization_id, date, item_id, 'STORE_001' AS store_id, round(sales, 4) AS sales,
                 CAST(NULL AS DOUBLE) AS sell_price, 0.0::DOUBLE AS revenue
          FROM r WHERE rn = 1 AND sales <> 0)"""


def pushed_rows(spark, sf):
    """Purchase events shaped as an upload with aliased column names."""
    ev = read_table(spark, sf, "events").filter(F.col("event_type") == "purchase")
    return ev.select("event_id", F.col("ts").alias("timestamp"), F.col("value").alias("qty"),
                     F.concat(F.lit("SKU"), F.get_json_object("props", "$.k")).alias("sku"),
                     F.col("ts").alias("_ts"))


@query("a11_pushed_rows_clean", PUSHED_SQL + "\nSELECT * FROM clean")
def a11(spark, sf):
    """Alias resolution, coercion, first-row dedupe, skip rule and revenue (B01-B08) on pushed rows."""
    return A.clean_batch(pushed_rows(spark, sf), TENANT, order=["_ts", "event_id"])


@query("a19_table_summary", PUSHED_SQL + """
SELECT organization_id, COUNT(DISTINCT item_id) AS products, COUNT(DISTINCT store_id) AS stores,
       COUNT(*) AS sales_rows, MIN(date) AS min_date, MAX(date) AS max_date,
       CAST(date_diff('day', MIN(date), MAX(date)) AS BIGINT) AS days_covered
FROM clean GROUP BY 1""")
def a19(spark, sf):
    """Products, stores, rows and date coverage of the ingested pushed rows."""
    return A.table_summary(A.clean_batch(pushed_rows(spark, sf), TENANT, order=["_ts", "event_id"]))


@query("a08_upsert_twice", PUSHED_SQL + """
SELECT organization_id, item_id, store_id, date, sales, revenue FROM clean""")
def a08(spark, sf):
    """The cleaned pushed rows upserted twice into a scratch sales table: the table
    holds each key once (idempotent upsert)."""
    root = scratch_path(spark, f"ingest-{uuid.uuid4().hex}")
    clean = A.clean_batch(pushed_rows(spark, sf), TENANT, order=["_ts", "event_id"])
    batch = clean.select(ORG, "item_id", "store_id", "date", "sales", "revenue",
                         F.lit("b1").alias("batch_id"), F.current_timestamp().alias("ingested_at"))
    A.upsert_table(spark, f"{root}/sales", batch, A.SALES_KEY)
    out = A.upsert_table(spark, f"{root}/sales", batch.withColumn("batch_id", F.lit("b2")), A.SALES_KEY)
    return out.select(ORG, "item_id", "store_id", "date", "sales", "revenue")


@query("b02_validate_upload", """
WITH e AS (SELECT ts, value FROM events WHERE event_type = 'purchase')
SELECT COUNT(*) AS rows, COUNT(CASE WHEN ts IS NULL THEN 1 END) AS bad_dates,
       CAST(MIN(ts) AS DATE) AS min_date, CAST(MAX(ts) AS DATE) AS max_date,
       COUNT(CASE WHEN value IS NULL AND FALSE THEN 1 END) AS non_numeric_sales,
       round(round(SUM(value), 2), 4) AS sales_sum, round(round(AVG(value), 2), 4) AS sales_mean,
       round(round(MIN(value), 2), 4) AS sales_min, round(round(MAX(value), 2), 4) AS sales_max,
       round(round(STDDEV_SAMP(value), 2), 4) AS sales_std, COUNT(CASE WHEN value < 0 THEN 1 END) AS negative_sales,
       COUNT(CASE WHEN value IS NULL THEN 1 END) AS missing_sales,
       true AS has_date, true AS has_sales, true AS has_item_id, false AS has_store_id, false AS has_sell_price,
       COUNT(CASE WHEN value IS NULL AND FALSE THEN 1 END) < COUNT(*) AS is_valid
FROM e""")
def b02(spark, sf):
    """Upload profile (validation report) of the pushed rows."""
    return A.validate_upload(pushed_rows(spark, sf).drop("_ts", "event_id")).drop("warnings")


@query("a16_materialized_daily_store", """
WITH e AS (
  SELECT CAST(ts AS DATE) AS date, 'SKU' || json_extract_string(props, '$.k') AS item_id,
         greatest(COALESCE(value, 0.0), 0.0) AS sales, event_id, ts
  FROM events WHERE event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY date, item_id ORDER BY ts, event_id) AS rn FROM e),
c AS (SELECT * FROM r WHERE rn = 1 AND sales <> 0)
SELECT 'events' AS organization_id, date, 'STORE_001' AS store_id, round(SUM(sales), 4) AS total_sales,
       COUNT(DISTINCT item_id) AS item_count
FROM c GROUP BY date""")
def a16(spark, sf):
    """Daily-by-store aggregate of the ingested pushed rows, written as a
    materialized table (A16) and read back."""
    root = scratch_path(spark, f"agg-{uuid.uuid4().hex}")
    clean = A.clean_batch(pushed_rows(spark, sf), TENANT, order=["_ts", "event_id"])
    A.materialize_aggregates(clean, root)
    return spark.read.parquet(f"{root}/agg_daily_store").select("organization_id", "date", "store_id",
                                                                 "total_sales", "item_count")
