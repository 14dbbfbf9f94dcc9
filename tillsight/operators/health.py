"""Data-health score and anomaly detectors.

Counts come from one aggregate per tenant; the exact median needed for the
price check comes from ``exact_quantiles``, which never gathers a tenant's
values in one task. Day gaps are the tenant's calendar (``sequence`` of
its min..max date, bounded by days) minus its observed dates, an anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.core import ORG, exact_quantiles, per_tenant

FRAME_COLUMNS = ["item_id", "store_id", "date", "sales", "sell_price", "category"]


def _status(v, warn, fail) -> F.Column:
    return F.when(v < warn, "pass").when(v < fail, "warn").otherwise("fail")


def daily_totals(fact: DataFrame) -> DataFrame:
    return fact.groupBy(ORG, "date").agg(F.sum("sales").alias("sales"))


def calendar_gaps(daily: DataFrame) -> DataFrame:
    """Calendar days between each tenant's first and last date with no sales row."""
    rng = daily.groupBy(ORG).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    cal = rng.select(ORG, F.explode(F.sequence("_lo", "_hi")).alias("date"))
    return cal.join(daily.select(ORG, "date"), [ORG, "date"], "left_anti")


def health_score(fact: DataFrame, columns: list[str] = FRAME_COLUMNS) -> DataFrame:
    """0-100 score per tenant from missing cells, duplicates, day gaps,
    negative sales and price anomalies (fail −20, warn −8)."""
    cols = [c for c in columns if c in fact.columns]
    nulls = sum((F.col(c).isNull().cast("bigint") for c in cols), F.lit(0).cast("bigint"))
    # one row per key, then per day: no distinct counts over the fact itself
    keyed = fact.withColumn("_nulls", nulls).groupBy(ORG, "date", "item_id", "store_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_nulls").alias("_nulls"),
        F.sum((F.col("sales") < 0).cast("bigint")).alias("_neg"), F.max("date").alias("_d"), F.max("item_id").alias("_i"), F.max("store_id").alias("_s"))
    whole = F.col("_d").isNotNull() & F.col("_i").isNotNull() & F.col("_s").isNotNull()
    by_day = keyed.groupBy(ORG, "date").agg(F.sum("_rows").alias("_rows"), F.sum("_nulls").alias("_nulls"), F.sum("_neg").alias("_neg"),
                                            F.count(F.when(whole, 1)).alias("_keys"))
    a = by_day.groupBy(ORG).agg(
        F.sum("_rows").alias("total_rows"), F.sum("_nulls").alias("missing_cells"), F.sum("_keys").alias("_distinct_keys"),
        F.sum("_neg").alias("negative_sales"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.count("date").alias("_n_days"))
    a = a.join(per_tenant(exact_quantiles(fact, [ORG], "sell_price", {"_median_price": 0.5})), ORG, "left")
    p = fact.select(ORG, "sell_price").join(per_tenant(a.select(ORG, "_median_price")), ORG)
    prices = p.groupBy(ORG).agg(
        F.sum((F.col("sell_price") > F.col("_median_price") * 10).cast("bigint")).alias("high_prices"),
        F.sum((F.col("sell_price") == 0).cast("bigint")).alias("zero_prices"),
        F.count("sell_price").alias("_n_prices"))
    j = a.join(prices, ORG, "left")
    missing_pct = F.when(F.col("total_rows") > 0,
                         F.col("missing_cells") / (F.col("total_rows") * len(cols)) * 100).otherwise(0.0)
    j = j.select(
        ORG, "total_rows", "missing_cells", missing_pct.alias("missing_pct"),
        (F.col("total_rows") - F.col("_distinct_keys")).alias("duplicates"),
        ((F.datediff("max_date", "min_date") + 1) - F.col("_n_days")).cast("bigint").alias("date_gaps"),
        "negative_sales", F.coalesce("zero_prices", F.lit(0)).alias("zero_prices"),
        F.coalesce("high_prices", F.lit(0)).alias("high_prices"), "_n_prices", "min_date", "max_date")
    st = {
        "missing_status": _status(F.col("missing_pct"), 1, 5),
        "duplicates_status": F.when(F.col("duplicates") == 0, "pass")
                              .when(F.col("duplicates") < F.col("total_rows") * 0.01, "warn").otherwise("fail"),
        "coverage_status": F.when(F.col("date_gaps") == 0, "pass").when(F.col("date_gaps") < 14, "warn")
                            .otherwise("fail"),
        "negative_status": F.when(F.col("negative_sales") == 0, "pass").otherwise("warn"),
        "price_status": F.when(F.col("_n_prices") == 0, F.lit(None))
                         .when(F.col("zero_prices") + F.col("high_prices") == 0, "pass").otherwise("warn"),
    }
    j = j.withColumns(st)
    penalty = sum((F.when(F.col(k) == "fail", 20).when(F.col(k) == "warn", 8).otherwise(0) for k in st),
                  F.lit(0))
    return (j.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("bigint"))
             .withColumn("price_issues", F.col("zero_prices") + F.col("high_prices"))
             .drop("_n_prices"))


def daily_anomalies(fact: DataFrame, z_threshold: float = 3.0, min_days: int = 14,
                    limit: int | None = None) -> DataFrame:
    """Days whose tenant total is ≥ z σ (sample) from the mean, plus missing days.

    Needs ≥ 14 observed days and σ > 0. ``limit`` caps rows per tenant (the
    reference shows 50); off by default so results stay whole.
    """
    d = daily_totals(fact)
    s = d.groupBy(ORG).agg(F.avg("sales").alias("_mean"), F.stddev_samp("sales").alias("_std"),
                           F.count(F.lit(1)).alias("_n"))
    ok = s.filter((F.col("_n") >= min_days) & (F.col("_std") > 0))
    z = (F.col("sales") - F.col("_mean")) / F.col("_std")
    spikes = (d.join(per_tenant(ok), ORG).withColumn("z", z).filter(F.abs("z") >= z_threshold)
               .select(ORG, F.when(F.col("z") > 0, "sales_spike").otherwise("sales_drop").alias("type"),
                       "date", "sales", F.col("_mean").alias("expected"),
                       (F.round(F.col("z") * 100, 0) / 100).alias("z_score"),
                       F.when(F.abs("z") >= 4, "high").otherwise("medium").alias("severity"),
                       F.lit(0).alias("_part")))
    gaps = (calendar_gaps(d).join(per_tenant(ok), ORG)
            .select(ORG, F.lit("missing_period").alias("type"), "date", F.lit(0.0).alias("sales"),
                    F.col("_mean").alias("expected"), F.lit(None).cast("double").alias("z_score"),
                    F.lit("low").alias("severity"), F.lit(1).alias("_part")))
    out = spikes.unionByName(gaps)
    if limit is not None:
        from pyspark.sql import Window
        w = Window.partitionBy(ORG).orderBy("_part", "date")
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")
    return out.drop("_part")


def transaction_anomalies(fact: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with negative quantity or negative revenue (= quantity × price)."""
    rev = F.col("sales") * F.coalesce("sell_price", F.lit(0.0))
    base = fact.select(ORG, "date", "item_id", "store_id", "sales", rev.alias("revenue"))
    neg_q = base.filter(F.col("sales") < 0).select(ORG, F.lit("negative_quantity").alias("type"), "date",
                                                   "item_id", "store_id", F.col("sales").alias("value"),
                                                   F.lit("medium").alias("severity"))
    neg_r = base.filter(F.col("revenue") < 0).select(ORG, F.lit("negative_revenue").alias("type"), "date",
                                                     "item_id", "store_id", F.col("revenue").alias("value"),
                                                     F.lit("medium").alias("severity"))
    out = neg_q.unionByName(neg_r)
    if limit is not None:
        from pyspark.sql import Window
        w = Window.partitionBy(ORG).orderBy("date", "item_id", "store_id", "type")
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")
    return out
