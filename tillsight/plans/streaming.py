"""Registered streaming queries (M01, M03): the ``events`` table read as a file
stream, drained with ``Trigger.AvailableNow``, results read back as a batch frame.

Scratch tables and checkpoints go under the session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillsight.plans.catalog import query
from tillsight.plans.ingest import PUSHED_SQL, TENANT
from tillsight.session import scratch_path
from tillsight.sources.tables import read_table
from tillsight.streaming import ingest as M


def _events_stream(spark, sf):
    schema = read_table(spark, sf, "events").schema
    return M.pushed_stream(spark, sf.rstrip("/"), schema, "parquet", glob="events.parquet")


@query("m01_stream_ingest", PUSHED_SQL + """
SELECT organization_id, item_id, store_id, date, sales, revenue FROM clean""")
def m01(spark, sf):
    """Pushed purchase rows ingested through a checkpointed stream with a keyed
    upsert per micro-batch; equals the batch ingest."""
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    ev = _events_stream(spark, sf).filter(F.col("event_type") == "purchase")
    rows = ev.select("event_id", F.col("ts").alias("timestamp"), F.col("value").alias("qty"),
                     F.concat(F.lit("SKU"), F.get_json_object("props", "$.k")).alias("sku"),
                     F.col("ts").alias("_ts"))
    q = M.ingest_stream(rows, f"{root}/sales", f"{root}/_ckpt", TENANT, order=["_ts", "event_id"])
    q.awaitTermination()
    return spark.read.parquet(f"{root}/sales").select("organization_id", "item_id", "store_id", "date", "sales",
                                                       "revenue")


@query("m03_stream_daily_aggregate", """
SELECT CAST(ts AS DATE) AS day, event_type, round(SUM(value), 4) AS total, COUNT(*) AS rows
FROM events GROUP BY 1, 2""")
def m03(spark, sf):
    """Daily totals per event type kept current by a watermarked streaming
    aggregate merged into a table."""
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    q = M.daily_aggregate_stream(_events_stream(spark, sf), f"{root}/daily", f"{root}/_ckpt", "ts",
                                 ["event_type"], "value", watermark="2 days")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/daily").select("day", "event_type", "total", "rows")


@query("m02_stream_deduplicated", PUSHED_SQL + """
SELECT organization_id, item_id, store_id, date, sales, revenue FROM clean""")
def m02(spark, sf):
    """Pushed rows that arrive twice (same event id) are dropped within the watermark
    before the upsert: the same table as without repeats."""
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    ev = _events_stream(spark, sf).filter(F.col("event_type") == "purchase")
    rows = ev.withColumn("_again", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "event_id", F.col("ts").alias("timestamp"), F.col("value").alias("qty"),
        F.concat(F.lit("SKU"), F.get_json_object("props", "$.k")).alias("sku"), F.col("ts").cast("timestamp").alias("_ts"))
    q = M.ingest_stream(rows, f"{root}/sales", f"{root}/_ckpt", TENANT, order=["_ts", "event_id"],
                        dedupe_watermark=("_ts", "60 days", "event_id"))
    q.awaitTermination()
    return spark.read.parquet(f"{root}/sales").select("organization_id", "item_id", "store_id", "date", "sales", "revenue")


@query("m03_stream_daily_store", """
SELECT CAST(ts AS DATE) AS day, 'S' || CAST(user_id % 6 AS VARCHAR) AS store_id, round(SUM(value), 4) AS total, COUNT(*) AS rows,
       COUNT(DISTINCT json_extract_string(props, '$.k')) AS item_count
FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""")
def m03s(spark, sf):
    """Daily totals and item counts per store, kept current by a stream."""
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    ev = _events_stream(spark, sf).filter(F.col("event_type") == "purchase").select(
        "ts", "value", F.concat(F.lit("S"), (F.col("user_id") % 6).cast("string")).alias("store_id"),
        F.get_json_object("props", "$.k").alias("item"))
    q = M.daily_aggregate_stream(ev, f"{root}/daily", f"{root}/_ckpt", "ts", ["store_id"], "value", item_col="item")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/daily").select("day", "store_id", "total", "rows", "item_count")


def _sale_rows(ev):
    return ev.select("ts", F.concat(F.lit("S"), (F.col("user_id") % 6).cast("string")).alias("store_id"), F.get_json_object("props", "$.k").alias("item"),
                     "value", F.format_string("%s %012d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "event_id").alias("pushed"))


@query("m03_stream_with_corrections", """
WITH e AS (SELECT CAST(ts AS DATE) AS day, 'S' || CAST(user_id % 6 AS VARCHAR) AS store_id, json_extract_string(props, '$.k') AS item, value, ts, event_id,
                  event_id % 5 = 0 AS corrected
           FROM events WHERE event_type = 'purchase'),
p AS (SELECT day, store_id, item, value, 0 AS file, ts, event_id FROM e
      UNION ALL SELECT day, store_id, item, value * 0.75, 1, ts, event_id FROM e WHERE corrected),
l AS (SELECT *, row_number() OVER (PARTITION BY day, store_id, item ORDER BY file DESC, ts DESC, event_id DESC) AS r FROM p)
SELECT day, store_id, round(SUM(value), 4) AS total, COUNT(*) AS item_count FROM l WHERE r = 1 GROUP BY 1, 2""")
def m03c(spark, sf):
    """Daily totals and item counts per store of an upserted table, kept by a stream that
    receives every purchase and then a file of corrections (every fifth one, at three quarters)."""
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    sales = _sale_rows(read_table(spark, sf, "events").filter(F.col("event_type") == "purchase"))
    again = _sale_rows(read_table(spark, sf, "events").filter((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0)))
    table, names = f"{root}/daily", ["day", "store_id", "total", "item_count"]
    for rows in (sales, again.withColumn("value", F.col("value") * 0.75)):  # two arrivals, two runs of one checkpointed stream
        rows.write.mode("append").parquet(f"{root}/pushed")
        stream = M.pushed_stream(spark, f"{root}/pushed", rows.schema, "parquet")
        M.corrected_daily_stream(stream, table, f"{root}/_ckpt", "ts", ["store_id"], "item", "value", "pushed", watermark="60 days").awaitTermination()
    return spark.read.parquet(table).select(*names)
