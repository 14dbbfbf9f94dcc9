"""Alert detectors, dedupe and alert-table maintenance.

Every detector emits rows of one schema (``ALERT_COLUMNS``) for all tenants at
once; J12 unions them, J11 drops those whose dedup key is already open (a
``left_anti`` join against the alert table), and J13/J14 read and update the
table by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions.core import ORG, per_tenant, round_half_away as rnd, tenant_as_of
from tillsight.operators.calendar import upcoming_holidays

ALERT_COLUMNS = [ORG, "alert_type", "severity", "title", "message", "context", "dedup_key"]


def _fmt0(c) -> Column:
    """Python ``f"{x:.0f}"``: round half to even on the binary value."""
    return F.bround(c, 0).cast("bigint").cast("string")


def _alert(df: DataFrame, alert_type: str, severity, title, message, ctx: dict) -> DataFrame:
    keys = sorted(ctx)
    context = F.to_json(F.struct(*[ctx[k].cast("string").alias(k) for k in keys]))
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select(
        ORG, F.lit(alert_type).alias("alert_type"), sev.alias("severity"), title.alias("title"),
        message.alias("message"), context.alias("context"),
        F.concat_ws(":", F.col(ORG), F.lit(alert_type), context).alias("dedup_key"))


def stockout_alerts(decisions: DataFrame, lead_days: int = 7) -> DataFrame:
    """Stock runs out within the lead time (critical ≤ 3 days, else high)."""
    d = decisions.filter(F.col("stockout_in_days").isNotNull() & (F.col("stockout_in_days") <= lead_days))
    days, qty = F.col("stockout_in_days"), F.col("recommended_order_qty")
    return _alert(d, "stockout_risk", F.when(days <= 3, "critical").otherwise("high"),
                  F.format_string("Stockout risk: %s @ %s", "item_id", "store_id"),
                  F.concat(F.lit("Stock runs out in ~"), _fmt0(days), F.lit(" days. Order "), _fmt0(qty),
                           F.lit(" units now.")),
                  {"item_id": F.col("item_id"), "store_id": F.col("store_id"), "days": days,
                   "stock": F.col("current_stock"), "order_qty": qty})


def overstock_alerts(decisions: DataFrame, excess_days: int = 90) -> DataFrame:
    """More than ``excess_days`` days of stock."""
    d = decisions.filter(F.col("days_of_stock").isNotNull() & (F.col("days_of_stock") > excess_days))
    cap = F.coalesce(F.col("overstock_capital"), F.lit(0.0))
    return _alert(d, "overstock", "medium",
                  F.format_string("Overstock: %s @ %s", "item_id", "store_id"),
                  F.concat(_fmt0(F.col("days_of_stock")), F.lit(" days of stock ($"), F.format_number(cap, 0),
                           F.lit(" tied up).")),
                  {"item_id": F.col("item_id"), "store_id": F.col("store_id"), "days": F.col("days_of_stock"),
                   "capital": cap})


def demand_changes(fact: DataFrame, as_of=None, scaled: bool = False) -> DataFrame:
    """J07 numbers: last-7-day vs the 21 days before, per series, relative to the
    tenant's latest date (calendar cut-offs). Sums of 7 and 21 days are compared
    as they are, as in the reference; ``scaled`` compares with a third of the prior sum."""
    f = fact.join(per_tenant(tenant_as_of(fact, as_of)), ORG)
    recent = F.col("date") > F.date_sub("as_of", 7)
    prior = (~recent) & (F.col("date") > F.date_sub("as_of", 28))
    g = f.groupBy(ORG, "item_id", "store_id").agg(
        F.coalesce(F.sum(F.when(recent, F.col("sales"))), F.lit(0.0)).alias("recent_sales"),
        F.coalesce(F.sum(F.when(prior, F.col("sales"))), F.lit(0.0)).alias("prior_sales"))
    if scaled:
        g = g.withColumn("prior_sales", F.col("prior_sales") / 3)
    return (g.filter(F.col("prior_sales") > 0)
             .withColumn("change_pct", (F.col("recent_sales") - F.col("prior_sales")) / F.col("prior_sales") * 100))


def demand_change_alerts(fact: DataFrame, spike_pct: float = 40.0, drop_pct: float = 40.0, as_of=None) -> DataFrame:
    """Demand spike (≥ +40 %, high) or drop (≤ −40 %, medium)."""
    c = demand_changes(fact, as_of)
    pct = F.col("change_pct")
    ctx = {"item_id": F.col("item_id"), "store_id": F.col("store_id"), "change_pct": rnd(pct, 1)}
    up = _alert(c.filter(pct >= spike_pct), "demand_spike", "high",
                F.format_string("Demand spike: %s @ %s", "item_id", "store_id"),
                F.concat(F.lit("Sales up "), _fmt0(pct), F.lit("% in the last 7 days. Consider stocking up.")), ctx)
    down = _alert(c.filter(pct <= -drop_pct), "demand_drop", "medium",
                  F.format_string("Demand drop: %s @ %s", "item_id", "store_id"),
                  F.concat(F.lit("Sales down "), _fmt0(F.abs(pct)), F.lit("% in the last 7 days.")), ctx)
    return up.unionByName(down)


def degradation_flag(registry: DataFrame) -> Column:
    """False unless both WAPEs are known; then live WAPE > 1.25 × eval WAPE, or
    |bias| > 0.15 × |live WAPE| (× 1 when the live WAPE is 0; a missing bias is 0)."""
    lw, w, b = F.col("live_wape"), F.col("wape"), F.abs(F.coalesce("live_bias", F.lit(0.0)))
    scale = F.when(lw == 0, F.lit(1.0)).otherwise(F.abs(lw))
    return F.coalesce((lw > w * 1.25) | (w.isNotNull() & (b / scale > 0.15)), F.lit(False))


def degradation_alerts(registry: DataFrame) -> DataFrame:
    """The active model's live accuracy degraded vs its evaluation."""
    a = registry.filter((F.col("status") == "active") & F.col("live_wape").isNotNull() & degradation_flag(registry))
    return _alert(a, "forecast_degradation", "high", F.lit("Forecast accuracy degraded"),
                  F.format_string("Live WAPE %.1f%% vs %.1f%% at training. Consider retraining or rolling back.",
                                  "live_wape", "wape"),
                  {"model_version": F.col("version"), "live_wape": F.col("live_wape"), "eval_wape": F.col("wape")})


def holiday_alerts(as_of_df: DataFrame, days_ahead: int = 7) -> DataFrame:
    """Holidays within ``days_ahead`` days of as_of."""
    up = upcoming_holidays(as_of_df, 10).filter(F.col("days_until").between(0, days_ahead))
    return _alert(up, "upcoming_holiday", "info", F.concat(F.lit("Upcoming holiday: "), F.col("name")),
                  F.format_string("%s is in %d days. Stock up early.", "name", "days_until"),
                  {"holiday": F.col("name"), "date": F.col("holiday_date"), "days_until": F.col("days_until")})


def store_zscores(fact: DataFrame, min_history: int = 14, as_of=None) -> DataFrame:
    """J10 numbers: per store, mean of the last 7 days' daily totals vs its history."""
    d = fact.groupBy(ORG, "store_id", "date").agg(F.sum("sales").alias("sales"))
    d = d.join(per_tenant(tenant_as_of(fact, as_of)), ORG)
    recent = F.col("date") > F.date_sub("as_of", 7)
    g = d.groupBy(ORG, "store_id").agg(
        F.avg(F.when(recent, F.col("sales"))).alias("recent_mean"),
        F.avg(F.when(~recent, F.col("sales"))).alias("hist_mean"),
        F.stddev_samp(F.when(~recent, F.col("sales"))).alias("hist_std"),
        F.count(F.when(~recent, 1)).alias("hist_days"))
    g = g.filter((F.col("hist_days") >= min_history) & (F.col("hist_std") > 0))
    return g.withColumn("z_score", (F.col("recent_mean") - F.col("hist_mean")) / F.col("hist_std"))


def store_anomaly_alerts(fact: DataFrame, z_threshold: float = 2.0, as_of=None) -> DataFrame:
    """|z| > 2 (high above 3)."""
    s = store_zscores(fact, as_of=as_of).filter(F.abs("z_score") > z_threshold)
    z = F.col("z_score")
    return _alert(s, "store_performance", F.when(F.abs(z) > 3, "high").otherwise("medium"),
                  F.concat(F.lit("Store anomaly: "), F.col("store_id")),
                  F.format_string("%s is running %.1fσ %s its historical average this week.", F.col("store_id"),
                                  F.abs(z), F.when(z > 0, "above").otherwise("below")),
                  {"store_id": F.col("store_id"), "z_score": rnd(z, 2)})


def detect_all(fact: DataFrame, decisions: DataFrame, registry: DataFrame | None = None,
               as_of=None) -> DataFrame:
    """Every detector for every tenant, one frame."""
    parts = [stockout_alerts(decisions), overstock_alerts(decisions), demand_change_alerts(fact, as_of=as_of),
             store_anomaly_alerts(fact, as_of=as_of), holiday_alerts(tenant_as_of(fact, as_of))]
    if registry is not None:
        parts.append(degradation_alerts(registry))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def new_alerts(candidates: DataFrame, alert_table: DataFrame | None) -> DataFrame:
    """Keep only alerts whose dedup key is not already open (unresolved);
    duplicates within the batch collapse to one."""
    c = candidates.dropDuplicates(["dedup_key"])
    if alert_table is None:
        return c
    open_keys = alert_table.filter(~F.col("is_resolved")).select("dedup_key")
    return c.join(open_keys, "dedup_key", "left_anti").select(*candidates.columns)


def counts_by_type(alerts: DataFrame) -> DataFrame:
    """Number of alerts per tenant and type."""
    return alerts.groupBy(ORG, "alert_type").agg(F.count(F.lit(1)).alias("n_alerts"))


def to_table_rows(alerts: DataFrame, created_at=None) -> DataFrame:
    """Shape new alerts as alert-table rows (unread, unresolved)."""
    ts = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    return alerts.select(*ALERT_COLUMNS, ts.alias("created_at"), F.lit(False).alias("is_read"),
                         F.lit(False).alias("is_resolved"), F.lit(None).cast("timestamp").alias("resolved_at"))


def list_alerts(table: DataFrame, include_resolved: bool = False, limit: int | None = None) -> DataFrame:
    """Alerts, open only by default, newest first."""
    t = table if include_resolved else table.filter(~F.col("is_resolved"))
    t = t.orderBy(F.desc("created_at"), "dedup_key")
    return t.limit(limit) if limit is not None else t


def alert_counts(table: DataFrame) -> DataFrame:
    """Open / unread counts and counts by severity per tenant."""
    open_ = ~F.col("is_resolved")
    sev = ["critical", "high", "medium", "low", "info"]
    return table.groupBy(ORG).agg(
        F.count(F.when(open_, 1)).alias("open"),
        F.count(F.when(open_ & ~F.col("is_read"), 1)).alias("unread"),
        *[F.count(F.when(open_ & (F.col("severity") == s), 1)).alias(s) for s in sev])


def mark(table: DataFrame, keys: DataFrame, read: bool | None = None, resolve: bool | None = None,
         at=None) -> DataFrame:
    """Mark the alerts whose ``dedup_key`` is in ``keys`` read and/or resolved.

    Returns the new table content; the caller writes it back (one keyed
    rewrite, as the upsert in A08).
    """
    k = keys.select("dedup_key").distinct().withColumn("_hit", F.lit(True))
    t = table.join(k, "dedup_key", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    ts = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    if read is not None:
        t = t.withColumn("is_read", F.when(hit, F.lit(read)).otherwise(F.col("is_read")))
    if resolve is not None:
        t = t.withColumn("is_resolved", F.when(hit, F.lit(resolve)).otherwise(F.col("is_resolved")))
        t = t.withColumn("resolved_at", F.when(hit & F.lit(resolve), ts).otherwise(F.col("resolved_at")))
    return t.select(*table.columns)
