"""Dashboard aggregates (D01-D17) over the canonical sales fact.

Every aggregate is keyed by ``organization_id`` first, so all tenants are
answered by one job. Top-k per tenant uses ``row_number() <= k``, which Spark
plans with a partial WindowGroupLimit before the shuffle (each task ships at
most k rows per tenant), so a hot tenant never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.calendar import season, weekday0
from tillsight.functions.core import ORG, exact_quantiles, finite, per_tenant, safe_div

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _day_name(idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), idx + 1)


def daily_store(fact: DataFrame) -> DataFrame:
    """Sales and distinct items per (tenant, date, store)."""
    return (fact.groupBy(ORG, "date", "store_id")
                .agg(F.sum("sales").alias("total_sales"),
                     F.countDistinct("item_id").alias("item_count")))


def tenant_totals(fact: DataFrame) -> DataFrame:
    """Per tenant: items, stores, categories, states, series, days, first and last date, sales, revenue (a missing
    price as 0; ``priced_revenue``: left out) and the mean daily total. The fact is aggregated once per series and once per day;
    different values are counted over those few rows, so no fact row is copied for each distinct count."""
    extra = [c for c in ("category", "state_id") if c in fact.columns]
    price = F.col("sell_price") if "sell_price" in fact.columns else F.lit(None).cast("double")
    series = fact.groupBy(ORG, "item_id", "store_id", *extra).agg(
        F.sum("sales").alias("_sales"), F.sum(F.col("sales") * F.coalesce(price, F.lit(0.0))).alias("_revenue"), F.sum(F.col("sales") * price).alias("_priced"))
    count = lambda *c: F.countDistinct(*c)
    a = series.groupBy(ORG).agg(
        count("item_id").alias("items"), count("store_id").alias("stores"), count("item_id", "store_id").alias("series"),
        (count("category") if "category" in extra else F.lit(0).cast("bigint")).alias("categories"),
        (count("state_id") if "state_id" in extra else F.lit(1).cast("bigint")).alias("states"),
        F.sum("_sales").alias("sales"), F.sum("_revenue").alias("revenue"), F.sum("_priced").alias("priced_revenue"))
    days = fact.groupBy(ORG, "date").agg(F.sum("sales").alias("_day")).groupBy(ORG).agg(
        F.count("date").alias("days"), F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.avg("_day").alias("avg_daily"))
    return a.join(per_tenant(days), ORG)


def overview(fact: DataFrame) -> DataFrame:
    """Headline KPIs per tenant."""
    return tenant_totals(fact).select(
        ORG, F.col("items").alias("total_products"), F.col("stores").alias("total_stores"), F.col("categories").alias("total_categories"),
        F.col("states").alias("total_states"), F.col("sales").alias("total_sales"), safe_div("sales", "days", 0.0).alias("avg_daily_sales"),
        "min_date", "max_date", F.col("series").alias("n_time_series"), F.col("revenue").alias("total_revenue"))


def product_totals(fact: DataFrame) -> DataFrame:
    """Per item sales, days sold, store count."""
    return (fact.groupBy(ORG, "item_id")
                .agg(F.sum("sales").alias("total_sales"),
                     F.countDistinct("date").alias("days_sold"),
                     F.countDistinct("store_id").alias("store_count")))


def top_products(fact: DataFrame, limit: int = 10) -> DataFrame:
    """Top-N items per tenant by total sales (ties by item_id)."""
    p = product_totals(fact)
    w = Window.partitionBy(ORG).orderBy(F.desc("total_sales"), F.asc("item_id"))
    return (p.withColumn("rank", F.row_number().over(w))
             .filter(F.col("rank") <= limit)
             .select(ORG, "rank", "item_id", "total_sales",
                     safe_div("total_sales", "days_sold", 0.0).alias("avg_daily_sales"),
                     "store_count"))


def daily_totals(fact: DataFrame) -> DataFrame:
    """Tenant daily totals over observed dates only (no gap filling)."""
    return fact.groupBy(ORG, "date").agg(F.sum("sales").alias("sales"))


def sales_trend(fact: DataFrame, days: int = 90) -> DataFrame:
    """Daily totals for the last ``days`` observed dates per tenant."""
    d = daily_totals(fact)
    w = Window.partitionBy(ORG).orderBy(F.desc("date"))
    return (d.withColumn("_rn", F.row_number().over(w))
             .filter(F.col("_rn") <= days).drop("_rn"))


def store_performance(fact: DataFrame) -> DataFrame:
    """Per store total, per-active-day mean, max daily distinct items."""
    d = daily_store(fact)
    s = d.groupBy(ORG, "store_id").agg(
        F.sum("total_sales").alias("total_sales"),
        F.countDistinct("date").alias("_days"),
        F.max("item_count").alias("item_count"))
    return s.select(ORG, "store_id", "total_sales",
                    safe_div("total_sales", "_days", 0.0).alias("avg_daily_sales"), "item_count")


def seasonal_breakdown(fact: DataFrame) -> DataFrame:
    """Total and per-day mean by season."""
    d = daily_store(fact).withColumn("season", season("date"))
    s = d.groupBy(ORG, "season").agg(F.sum("total_sales").alias("total_sales"),
                                     F.countDistinct("date").alias("_days"))
    return s.select(ORG, "season", safe_div("total_sales", "_days", 0.0).alias("avg_sales"),
                    "total_sales")


def day_of_week(fact: DataFrame) -> DataFrame:
    """Mean of (date, store) totals by weekday and percent of the peak weekday."""
    d = daily_store(fact).withColumn("dow", weekday0("date"))
    a = d.groupBy(ORG, "dow").agg(F.avg("total_sales").alias("avg_sales"))
    peak = F.max("avg_sales").over(Window.partitionBy(ORG))
    return a.select(ORG, F.col("dow").cast("bigint").alias("dow"), _day_name(F.col("dow")).alias("day"),
                    "avg_sales",
                    F.when(peak > 0, F.col("avg_sales") / peak * 100).otherwise(0.0).alias("pct_of_peak"))


def breakdown(fact: DataFrame, by: str) -> DataFrame:
    """Total / mean sales by category, store, year-month or weekday."""
    f = fact
    keys = [ORG]
    if by == "month":
        f = f.withColumn("year", F.year("date").cast("bigint")).withColumn("month", F.month("date").cast("bigint"))
        keys += ["year", "month"]
    elif by == "weekday":
        f = f.withColumn("dow", weekday0("date").cast("bigint"))
        keys += ["dow"]
    else:
        keys += [by]
    return f.groupBy(*keys).agg(F.sum("sales").alias("total_sales"),
                                F.avg("sales").alias("avg_sales"),
                                F.count(F.lit(1)).alias("n_rows"))


def event_uplift(frame: DataFrame, flag: str = "is_holiday") -> DataFrame:
    """Mean sales with vs without an event flag, and uplift %."""
    a = frame.groupBy(ORG).agg(
        F.avg(F.when(F.col(flag) == 1, F.col("sales"))).alias("avg_with_event"),
        F.avg(F.when(F.col(flag) == 0, F.col("sales"))).alias("avg_without_event"))
    return a.withColumn("uplift_pct",
                        (safe_div("avg_with_event", "avg_without_event") - 1) * 100)


def describe(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Per tenant and column: count, nulls, mean, sample std, min, quartiles, max.

    The frame is unpivoted to (column, value) rows and grouped by (tenant,
    column); quartiles are exact linear percentiles (``exact_quantiles``).
    """
    long = frame.select(ORG, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ORG, columns, "column", "value")
    basic = long.groupBy(ORG, "column").agg(
        F.count("value").alias("count"),
        F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).cast("bigint").alias("null_count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, [ORG, "column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(per_tenant(q), [ORG, "column"], "left").select(
        ORG, "column", "count", "null_count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    """Value counts of one column per tenant."""
    return frame.groupBy(ORG, column).agg(F.count(F.lit(1)).alias("count"))


def price_histogram(fact: DataFrame, bins: int = 50, column: str = "sell_price") -> DataFrame:
    """Equal-width histogram between the tenant's min and max (max falls in the last bin)."""
    f = fact.filter(F.col(column).isNotNull())
    rng = f.groupBy(ORG).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = (f.select(ORG, column).join(per_tenant(rng), ORG)
          .withColumn("bin", F.when(F.col("_hi") == F.col("_lo"), F.lit(0))
                      .otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1)))
                      .cast("bigint")))
    return (b.groupBy(ORG, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
             .select(ORG, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                     (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"), "count"))


def iqr_outliers(fact: DataFrame, k: float = 1.5, column: str = "sales") -> DataFrame:
    """Rows outside [Q1 - k·IQR, Q3 + k·IQR] per tenant: count, %, describe."""
    q = exact_quantiles(fact, [ORG], column, {"q1": 0.25, "q3": 0.75}).join(
        per_tenant(fact.groupBy(ORG).agg(F.count(F.lit(1)).alias("n_rows"))), ORG)
    f = fact.select(ORG, column).join(per_tenant(q), ORG)
    iqr = F.col("q3") - F.col("q1")
    out = (F.col(column) < F.col("q1") - k * iqr) | (F.col(column) > F.col("q3") + k * iqr)
    return (f.groupBy(ORG, "q1", "q3", "n_rows")
             .agg(F.count(F.when(out, 1)).alias("n_outliers"),
                  F.avg(F.when(out, F.col(column))).alias("outlier_mean"),
                  F.min(F.when(out, F.col(column))).alias("outlier_min"),
                  F.max(F.when(out, F.col(column))).alias("outlier_max"))
             .withColumn("outlier_pct", F.col("n_outliers") / F.col("n_rows") * 100))


def target_correlation(frame: DataFrame, features: list[str], target: str = "sales", digits: int | None = None) -> DataFrame:
    """Pearson correlation of every feature with the target, one pass; per tenant, largest first (NULL, a
    feature without spread, last). ``digits``: of the values rounded so.

    The tasks that hold the rows merge, for each tenant and feature, the mean, spread and product moments over rows with both
    values, batch by batch around their means; one row per task, tenant and feature is left to be merged by key.
    """
    names = [*features, target]
    sums = ("n", "x", "y", "xx", "yy", "xy")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            which = codes.indices.to_numpy(zero_copy_only=False)
            v, known = np.empty((len(names), len(which))), np.empty((len(names), len(which)), bool)
            for i in range(len(names)):
                column = batch.column(i + 1)
                known[i] = column.is_valid().to_numpy(zero_copy_only=False)
                v[i] = column.to_numpy(zero_copy_only=False)
            if digits is not None:
                v = _rounded_half_away(v, digits)
            for k, tenant in enumerate(codes.dictionary.to_pylist()):
                mine = which == k
                with np.errstate(all="ignore"):  # non-finite values give a NULL in the end
                    part = _moments(v[:-1, mine], v[-1, mine], known[:-1, mine] & known[-1, mine])
                    held[tenant] = _merged(held[tenant], part) if tenant in held else part
        if held:
            cols = [np.concatenate(c) for c in zip(*held.values())]
            yield pa.RecordBatch.from_arrays([
                pa.array([t for t in held for _ in features], pa.string()), pa.array([*features] * len(held), pa.string()), *map(pa.array, cols)],
                names=[ORG, "feature", *sums, "lo", "hi", "ylo", "yhi"])

    kinds = ", ".join(f"{c} double" for c in (*sums, "lo", "hi", "ylo", "yhi"))
    rows = frame.select(ORG, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    parts = rows.mapInArrow(run, f"{ORG} string, feature string, {kinds}")
    # a row per task, tenant and feature: collected by key and merged there
    fold = lambda a, b: F.struct(*_merged_columns(a, b, sums))
    item = F.struct(*sums, "lo", "hi", "ylo", "yhi")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in sums], *[F.lit(x).alias(c) for c, x in (("lo", float("inf")), ("hi", float("-inf")), ("ylo", float("inf")), ("yhi", float("-inf")))])
    each = parts.groupBy(ORG, "feature").agg(F.aggregate(F.array_sort(F.collect_list(item)), zero, fold).alias("_m")).select(ORG, "feature", "_m.*")
    varies = (F.col("n") > 0) & (F.col("lo") < F.col("hi")) & (F.col("ylo") < F.col("yhi"))
    corr = F.when(varies, finite(F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))))
    return each.select(ORG, "feature", corr.alias("corr")).orderBy(ORG, F.desc_nulls_last("corr"), "feature")


def _rounded_half_away(v, digits: int):
    """``round_half_away`` of a matrix."""
    import numpy as np
    with np.errstate(all="ignore"):
        scaled = v * float(10 ** digits)
        size = np.abs(scaled)
        low = np.floor(size)
        out = np.copysign(low + (size - low >= 0.5), scaled) / float(10 ** digits)
    return np.where(np.isfinite(scaled), out, scaled / float(10 ** digits))


def _moments(x, y, known):
    """n, means, spreads, product moments and extremes of each row of ``x`` with ``y`` where ``known``. Values are taken less
    the first known one, so that a constant has a spread of exactly 0."""
    import numpy as np
    n = known.sum(1).astype(float)
    first = known.argmax(1)
    x0, y0 = x[np.arange(len(x)), first], y[first]
    empty = n == 0
    x0, y0 = np.where(empty, 0.0, x0), np.where(empty, 0.0, y0)
    dx, dy = np.where(known, x - x0[:, None], 0.0), np.where(known, y[None, :] - y0[:, None], 0.0)
    some = np.maximum(n, 1.0)
    mx, my = dx.sum(1) / some, dy.sum(1) / some
    xx, yy, xy = ((a * b).sum(1) for a, b in ((dx, dx), (dy, dy), (dx, dy)))
    ends = [f(np.where(known, a, fill), axis=1) for a in (x, np.broadcast_to(y, x.shape)) for f, fill in ((np.min, np.inf), (np.max, -np.inf))]
    return n, x0 + mx, y0 + my, xx - n * mx * mx, yy - n * my * my, xy - n * mx * my, *ends


def _merged(a, b):
    """Moments of two disjoint sets of rows, together."""
    import numpy as np
    n = a[0] + b[0]
    some = np.maximum(n, 1.0)
    dx, dy, share = b[1] - a[1], b[2] - a[2], b[0] / some
    both = a[0] * share
    return (n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both,
            np.minimum(a[6], b[6]), np.maximum(a[7], b[7]), np.minimum(a[8], b[8]), np.maximum(a[9], b[9]))


def _merged_columns(a, b, sums):
    """``_merged`` of two structs."""
    n = a["n"] + b["n"]
    share = b["n"] / F.greatest(n, F.lit(1.0))
    dx, dy, both = b["x"] - a["x"], b["y"] - a["y"], a["n"] * share
    out = (n, a["x"] + dx * share, a["y"] + dy * share, a["xx"] + b["xx"] + dx * dx * both, a["yy"] + b["yy"] + dy * dy * both, a["xy"] + b["xy"] + dx * dy * both)
    return [*[c.alias(k) for c, k in zip(out, sums)], F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"),
            F.least(a["ylo"], b["ylo"]).alias("ylo"), F.greatest(a["yhi"], b["yhi"]).alias("yhi")]


def hierarchy_counts(fact: DataFrame) -> DataFrame:
    """Distinct counts per level and calendar coverage per tenant."""
    # one row per series and per day first: the fact itself is not copied once per distinct count
    series = fact.groupBy(ORG, "item_id", "store_id", "category").agg(F.count(F.lit(1)).alias("_rows"))
    days = fact.groupBy(ORG, "date").agg(F.lit(1).alias("_one")).groupBy(ORG).agg(
        F.count("date").alias("n_days"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    a = series.groupBy(ORG).agg(
        F.countDistinct("item_id").alias("n_items"),
        F.countDistinct("store_id").alias("n_stores"),
        F.countDistinct("category").alias("n_categories"),
        F.countDistinct("item_id", "store_id").alias("n_series"),
        F.sum("_rows").alias("n_rows")).join(per_tenant(days), ORG)
    cal = (F.datediff("max_date", "min_date") + 1).cast("bigint")
    return a.withColumn("calendar_days", cal).withColumn("missing_days", cal - F.col("n_days"))


def store_page_totals(stores: DataFrame) -> DataFrame:
    """Sum of sales and revenue, mean growth over stores that have one."""
    return stores.groupBy(ORG).agg(F.sum("total_sales").alias("total_sales"),
                                   F.sum("total_revenue").alias("total_revenue"),
                                   F.avg("growth_pct").alias("avg_growth_pct"),
                                   F.count(F.lit(1)).alias("n_stores"))


def category_counts(products: DataFrame) -> DataFrame:
    """Product count per category."""
    return products.groupBy(ORG, "category").agg(F.countDistinct("item_id").alias("n_products"))
