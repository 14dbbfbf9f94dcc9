"""Structured Streaming: continuous ingest, incremental aggregates and alert dedupe.

* M01/M02: a file stream of pushed rows; each micro-batch runs the batch
  cleaner (B01-B08) and the keyed upsert (A08) inside ``foreachBatch``. The
  sink is idempotent by key, so a replayed batch after a failure (the
  checkpoint guarantees replay) leaves the same table: exactly-once effect.
  Exact repeats inside the stream can also be dropped early with
  ``dropDuplicatesWithinWatermark``.
* M03: daily aggregate kept current with a watermark, emitted in update mode
  and merged by key into a table (late rows inside the watermark update their
  day; the table can always be rebuilt from the sales table).
  Where pushed rows may correct earlier ones, ``corrected_daily_stream`` keeps the last
  value of each (day, store, item) in keyed state and emits differences.
* M04: ``Trigger.AvailableNow`` drains what has arrived, then batch jobs run.
* M05: alert dedupe in ``foreachBatch``: only keys not already open are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.core import ORG
from tillsight.operators import alerts as A
from tillsight.sources import ingest as I


def pushed_stream(spark: SparkSession, path: str, schema, file_format: str = "json",
                  glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """M01 source: files of pushed rows landing in ``path``."""
    r = spark.readStream.format(file_format).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def ingest_stream(stream: DataFrame, table_path: str, checkpoint: str, organization_id,
                  order: str | list[str] = "_pos", available_now: bool = True,
                  dedupe_watermark: tuple | None = None):
    """Clean every micro-batch and upsert it by (tenant, date, item, store).

    Within a micro-batch the first row per key wins (B06); across batches the
    later batch replaces the earlier row (last write wins, as the reference's
    upsert). ``dedupe_watermark`` = (event time, delay, key columns...) drops
    pushed rows that repeat a key within the delay (M02). Returns the started query.
    """
    s = stream
    if dedupe_watermark is not None:
        ts, delay, *names = dedupe_watermark
        s = s.withWatermark(ts, delay).dropDuplicatesWithinWatermark(names)

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        clean = I.clean_batch(batch, organization_id, order)
        rows = clean.select(ORG, "item_id", "store_id", "date", "sales", "revenue",
                            F.lit(str(epoch_id)).alias("batch_id"), F.current_timestamp().alias("ingested_at"))
        I.upsert_table(spark, table_path, rows, I.SALES_KEY)

    w = s.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def daily_aggregate_stream(stream: DataFrame, table_path: str, checkpoint: str, ts_col: str, keys: list[str],
                           value_col: str, watermark: str = "2 days", available_now: bool = True,
                           item_col: str | None = None):
    """Per (day, keys) sum, count and, with ``item_col``, number of different
    items (the day's items are kept in the state), merged into a table by month.

    Update mode emits the days touched by each micro-batch; ``foreachBatch``
    merges them by (day, keys), so the table always holds the latest value.
    """
    tz = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    # Event time as an instant whose UTC wall clock is the row's local wall
    # clock, so 1-day windows (aligned on UTC midnight) are local calendar days
    # whatever the session time zone; works for TIMESTAMP and TIMESTAMP_NTZ input.
    ev = stream.withColumn("_event_time", F.to_utc_timestamp(F.col(ts_col).cast("timestamp"), tz))
    agg = (ev.withWatermark("_event_time", watermark)
             .groupBy(F.window("_event_time", "1 day").alias("w"), *keys)
             .agg(F.sum(value_col).alias("total"), F.count(F.lit(1)).alias("rows"),
                  *([F.size(F.collect_set(item_col)).alias("item_count")] if item_col else [])))
    out = agg.select(F.to_date(F.from_utc_timestamp(F.col("w.start"), tz)).alias("day"), *keys, "total", "rows",
                     *(["item_count"] if item_col else []))

    def merge(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        I.upsert_table(spark, table_path, batch, ["day", *keys], ["month"])

    w = out.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def corrected_daily_stream(stream: DataFrame, table_path: str, checkpoint: str, ts_col: str, keys: list[str], item_col: str,
                           value_col: str, order_col: str, watermark: str = "2 days", available_now: bool = True):
    """M03 under corrections: per (day, keys) total and number of items, where a later row of the same (day, keys,
    item) replaces the earlier one, as the keyed upsert does (within a micro-batch the largest ``order_col`` wins,
    of equal ones the larger value; across micro-batches the later one).

    State: one value per (day, keys, item), so no task holds a day's items; it goes when the watermark has
    passed its day, and rows later than that are dropped. What leaves the state are differences (new value less the
    last), summed per (day, keys) and added to the table. Each row of the table also keeps the last micro-batch that
    changed it and its values before, so a micro-batch that is replayed after a failure is added only once.
    """
    import pandas as pd

    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    tz = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    at = F.to_utc_timestamp(F.col(ts_col).cast("timestamp"), tz)  # the local wall clock, as an instant of the stream's time zone
    rows = stream.select(at.alias("_at"), F.to_date(F.col(ts_col).cast("timestamp")).alias("day"), *keys, F.col(item_col).alias("_item"),
                         F.col(value_col).cast("double").alias("_value"), F.col(order_col).cast("string").alias("_order")).withWatermark("_at", watermark)

    def difference(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = None
        for frame in frames:
            newest = frame.sort_values(["_order", "_value"]).iloc[-1]
            if last is None or (newest["_order"], newest["_value"]) > last:
                last = (newest["_order"], newest["_value"])
        known = state.exists
        old = state.get[0] if known else 0.0
        state.update((float(last[1]),))
        end = pd.Timestamp(key[0]) + pd.Timedelta(days=1)
        state.setTimeoutTimestamp(int(end.timestamp() * 1000))
        yield pd.DataFrame([[*key[:-1], float(last[1]) - old, 0 if known else 1]], columns=["day", *keys, "change", "items"])

    changes = rows.groupBy("day", *keys, "_item").applyInPandasWithState(
        difference, f"day date, {named}, change double, items long", "value double", "append", "EventTimeTimeout")

    def add(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        add_up = batch.groupBy("day", *keys).agg(F.sum("change").alias("change"), F.sum("items").alias("items"))
        new = add_up.withColumns({"before_total": F.lit(0.0), "before_items": F.lit(0).cast("long")})
        if I._exists(spark, table_path):
            mine = F.col("epoch") == epoch_id  # this micro-batch was added before: start again from the values before it
            months = add_up.select((F.year("day") * 100 + F.month("day")).alias("month")).distinct()
            old = spark.read.parquet(table_path).join(months, "month", "left_semi").select("day", *keys, F.when(mine, F.col("before_total")).otherwise(F.col("total")).alias("_t"),
                                                        F.when(mine, F.col("before_items")).otherwise(F.col("item_count")).alias("_i"))
            new = add_up.join(old, ["day", *keys], "left").withColumns({"before_total": F.coalesce("_t", F.lit(0.0)), "before_items": F.coalesce("_i", F.lit(0).cast("long"))})
        out = new.select("day", *keys, (F.col("before_total") + F.col("change")).alias("total"), (F.col("before_items") + F.col("items")).alias("item_count"),
                         "before_total", "before_items", F.lit(epoch_id).cast("long").alias("epoch"))
        I.upsert_table(spark, table_path, out, ["day", *keys], ["month"])

    w = changes.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def alert_stream(candidates: DataFrame, alert_table: str, checkpoint: str, available_now: bool = True):
    """Append only alerts whose dedup key is not already open in the table."""

    def emit(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        existing = spark.read.parquet(alert_table) if I._exists(spark, alert_table) else None
        new = A.new_alerts(batch, existing)
        A.to_table_rows(new).write.mode("append").parquet(alert_table)

    w = candidates.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def run_models(spark: SparkSession, root: str, fact: DataFrame, as_of, compare=None, max_age_days: int = 7) -> dict[str, DataFrame]:
    """M04, models: score the forecasts that matured since the last run (a ledger of evaluated header and date
    pairs), put the live metrics on the active versions, retrain the tenants whose model is missing, degraded or
    ``max_age_days`` old, and promote what clears the bar. ``compare``: sales rows -> comparison (G06).

    Tables under ``root``: forecast_headers, forecast_details, model_registry (rewritten as a new
    version folder, the newest of which counts), accuracy_sums and accuracy_ledger.
    """
    from tillsight.operators import registry as R
    if compare is None:
        from tillsight.operators import features as E
        from tillsight.operators import models as G
        compare = lambda rows: G.compare_models(E.all_features(rows))
    headers, details = (spark.read.parquet(f"{root}/{t}") for t in ("forecast_headers", "forecast_details"))
    R.evaluate_matured(spark, root, headers, details, fact, as_of)
    before = R.current_registry(spark, root)
    after = R.auto_retrain(R.apply_live_metrics(before, R.live_from_sums(spark, root)), fact, compare, as_of, max_age_days)
    return {"accuracy": R.accuracy_from_sums(spark, root), "registry": R.store_registry(after, root, str(as_of))}


def run_daily(spark: SparkSession, root: str, as_of=None) -> dict[str, DataFrame]:
    """The daily batch recompute over the ingested tables — insights,
    inventory decisions, alerts — for all tenants in one job each, and, where
    forecasts and a registry are stored, ``run_models``."""
    from tillsight.operators import insights as INS
    from tillsight.operators import inventory as H
    fact = I.load_sales(spark, root)
    stock = I.load_inventory(spark, root) if I._exists(spark, f"{root}/inventory_levels") else None
    stats = H.series_stats(fact, stock)
    dec = H.purchase_decisions(stats, as_of=as_of)
    out = {"insights": INS.insights(fact), "decisions": dec,
           "alerts": A.new_alerts(A.detect_all(fact, dec, as_of=as_of), None)}
    if I._exists(spark, f"{root}/forecast_headers") and I._exists(spark, f"{root}/model_registry"):
        day = as_of or fact.agg(F.max("date")).first()[0]
        out |= run_models(spark, root, fact, day)
    return out
