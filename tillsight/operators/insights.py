"""Written insights, executive overview and store / product drill-downs.

Each insight is computed for every tenant in one pass and returned as rows
``(organization_id, insight_type, insight_text, category, severity)`` plus the
numbers behind the sentence, so the numbers can be checked independently of
the wording. Drill-downs (I12, I13) compute every store / product at once:
per-key aggregates joined together, top-k per key by ``row_number``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import calendar as C
from tillsight.functions.core import ORG, checked_broadcast, exact_quantiles, per_tenant, round_half_away as rnd, safe_div, split_rank
from tillsight.operators.calendar import add_holiday_features, holiday_calendar, season_weather
from tillsight.operators.dashboards import tenant_totals
from tillsight.sources.tables import materialize

INSIGHT_COLUMNS = [ORG, "insight_type", "insight_text", "category", "severity"]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DAY_ABBR = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Fixed values that must equal the reference's.
SEASON_EMOJI = {"Spring": "🌸", "Summer": "☀️", "Monsoon": "🌧️", "Autumn": "🍂",
                "Winter": "❄️"}


def n0(c) -> Column:
    """``f"{x:,.0f}"``."""
    return F.format_number(c, 0)


def n1(c) -> Column:
    return F.format_string("%.1f", c)


def _pick(names: list[str], idx) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), idx.cast("int") + 1)


def _sentence(df: DataFrame, when, itype: str, text: Column, category: str, severity="info") -> tuple:
    """A sentence that a frame of numbers tells where ``when`` holds."""
    row = F.struct(F.lit(itype).alias("insight_type"), text.alias("insight_text"), F.lit(category).alias("category"),
                   (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    return df, F.when(F.lit(when) if isinstance(when, bool) else when, row)


def _tell(sentences: list[tuple]) -> DataFrame:
    """Insight rows of all sentences: each frame of numbers is derived once, whatever it tells."""
    out = None
    for df in {id(df): df for df, _ in sentences}.values():
        told = F.filter(F.array(*[row for d, row in sentences if d is df]), lambda x: x.isNotNull())
        rows = df.select(ORG, F.explode(told).alias("_s")).select(ORG, "_s.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def daily(fact: DataFrame, keys=(ORG,)) -> DataFrame:
    return fact.groupBy(*keys, "date").agg(F.sum("sales").alias("sales"))


# ------------------------------------------------------------------ numbers

def overall_numbers(fact: DataFrame) -> DataFrame:
    """Products, stores, days, total, mean daily total, revenue."""
    return tenant_totals(fact).select(ORG, "items", "stores", "days", F.col("sales").alias("total_sales"), F.col("priced_revenue").alias("revenue"), "avg_daily")


def trend_numbers(fact: DataFrame) -> DataFrame:
    """Mean of the last 7 observed daily totals vs the 7 before (≥ 14 days);
    weekday means of row sales, strongest / weakest weekday and spread."""
    d = daily(fact)
    w = Window.partitionBy(ORG).orderBy(F.desc("date"))
    r = d.withColumn("_rn", F.row_number().over(w))
    t = r.groupBy(ORG).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg(F.when(F.col("_rn") <= 7, F.col("sales"))).alias("recent_mean"),
        F.avg(F.when((F.col("_rn") > 7) & (F.col("_rn") <= 14), F.col("sales"))).alias("prior_mean"))
    t = t.filter(F.col("n_days") >= 14).withColumn(
        "change_pct", F.when(F.col("prior_mean") > 0,
                             (F.col("recent_mean") - F.col("prior_mean")) / F.col("prior_mean") * 100))
    dow = (fact.groupBy(ORG, C.weekday0("date").alias("dow")).agg(F.avg("sales").alias("m"))
               .groupBy(ORG).agg(F.min_by("dow", F.struct(-F.col("m"), F.col("dow"))).alias("best_dow"),
                                 F.min_by("dow", F.struct(F.col("m"), F.col("dow"))).alias("worst_dow"),
                                 F.max("m").alias("_mx"), F.min("m").alias("_mn"), F.avg("m").alias("_avg"),
                                 F.count(F.lit(1)).alias("n_dow")))
    dow = dow.withColumn("dow_spread_pct", (F.col("_mx") - F.col("_mn")) / F.col("_avg") * 100).drop(
        "_mx", "_mn", "_avg")
    return t.join(dow, ORG, "left")


def product_numbers(fact: DataFrame) -> DataFrame:
    """Top 3 items, top-3 share of sales, slow movers (< 10 % of the median item)."""
    p = fact.groupBy(ORG, "item_id").agg(F.sum("sales").alias("units"))
    w = Window.partitionBy(ORG).orderBy(F.desc("units"), "item_id")
    top = (p.withColumn("_rk", F.row_number().over(w)).filter("_rk <= 3")
            .groupBy(ORG).agg(F.sort_array(F.collect_list(F.struct("_rk", "item_id", "units"))).alias("top3"),
                              F.sum("units").alias("top3_units")))
    a = p.groupBy(ORG).agg(F.count(F.lit(1)).alias("n_items"), F.sum("units").alias("total_units"))
    a = a.join(per_tenant(exact_quantiles(p, [ORG], "units", {"median_units": 0.5})), ORG, "left")
    slow = (p.join(per_tenant(a.select(ORG, "median_units")), ORG)
             .groupBy(ORG).agg(F.count(F.when(F.col("units") < F.col("median_units") * 0.1, 1)).alias("slow_movers")))
    return (a.join(top, ORG, "left").join(slow, ORG, "left")
             .withColumn("top3_pct", F.col("top3_units") / F.col("total_units") * 100))


def store_numbers(fact: DataFrame) -> DataFrame:
    """Best store, best / worst ratio."""
    s = fact.groupBy(ORG, "store_id").agg(F.sum("sales").alias("units"))
    return s.groupBy(ORG).agg(
        F.count(F.lit(1)).alias("n_stores"),
        F.min_by("store_id", F.struct(-F.col("units"), F.col("store_id"))).alias("top_store"),
        F.max("units").alias("top_units"), F.min("units").alias("bottom_units")
    ).withColumn("ratio", safe_div("top_units", "bottom_units"))


def seasonality_numbers(fact: DataFrame) -> DataFrame:
    """Peak / lowest (year, month) and the weekend vs weekday row mean uplift."""
    m = fact.groupBy(ORG, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("sales").alias("units"))
    mm = m.groupBy(ORG).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.min_by(F.struct("year", "month", "units"), F.struct(-F.col("units"), "year", "month")).alias("peak"),
        F.min_by(F.struct("year", "month", "units"), F.struct(F.col("units"), "year", "month")).alias("low"))
    we = C.weekday0("date") >= 5
    u = fact.groupBy(ORG).agg(F.avg(F.when(we, F.col("sales"))).alias("weekend_mean"),
                              F.avg(F.when(~we, F.col("sales"))).alias("weekday_mean"))
    u = u.withColumn("weekend_mean", F.coalesce("weekend_mean", F.lit(0.0))) \
         .withColumn("weekday_mean", F.coalesce("weekday_mean", F.lit(1.0)))
    u = u.withColumn("weekend_uplift_pct", F.when(F.col("weekday_mean") > 0,
                                                  (F.col("weekend_mean") - F.col("weekday_mean"))
                                                  / F.col("weekday_mean") * 100))
    return mm.join(u, ORG)


def anomaly_numbers(fact: DataFrame, k: float = 3.0) -> DataFrame:
    """Rows above Q3 + 3·IQR (exact linear quantiles)."""
    q = exact_quantiles(fact, [ORG], "sales", {"q1": 0.25, "q3": 0.75}).join(
        per_tenant(fact.groupBy(ORG).agg(F.count("sales").alias("n_rows"))), ORG)
    j = fact.select(ORG, "sales").join(per_tenant(q), ORG)
    return (j.groupBy(ORG, "q1", "q3", "n_rows")
             .agg(F.count(F.when(F.col("sales") > F.col("q3") + k * (F.col("q3") - F.col("q1")), 1)).alias("n_high"))
             .withColumn("high_pct", F.col("n_high") / F.col("n_rows") * 100))


def season_numbers(fact: DataFrame) -> DataFrame:
    """Per season mean / sum / std of row sales; best and worst season by sum."""
    s = fact.groupBy(ORG, C.season("date").alias("season")).agg(
        F.avg("sales").alias("mean"), F.sum("sales").alias("sum"), F.stddev_samp("sales").alias("std"))
    return s.groupBy(ORG).agg(
        F.count(F.lit(1)).alias("n_seasons"),
        F.min_by(F.struct("season", "sum"), F.struct(-F.col("sum"), "season")).alias("best"),
        F.min_by(F.struct("season", "sum"), F.struct(F.col("sum"), "season")).alias("worst")
    ).withColumn("ratio", F.col("best.sum") / F.col("worst.sum"))


TEMP_BANDS = [(0, 15, "<15°C"), (15, 25, "15-25°C"), (25, 35, "25-35°C"), (35, 50, ">35°C")]


def temp_band(t) -> Column:
    e = None
    for lo, hi, lab in TEMP_BANDS:
        cond = (t > lo) & (t <= hi)
        e = F.when(cond, F.lit(lab)) if e is None else e.when(cond, F.lit(lab))
    return e


def weather_numbers(fact: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Mean row sales per temperature band (season-default temperature
    unless a weather table is given); highest and lowest band."""
    f = season_weather(fact, "date", weather)
    b = f.withColumn("band", temp_band(F.col("temp_c"))).filter(F.col("band").isNotNull())
    order = F.expr("CASE band WHEN '<15°C' THEN 0 WHEN '15-25°C' THEN 1 WHEN '25-35°C' THEN 2 ELSE 3 END")
    g = b.groupBy(ORG, "band", order.alias("_o")).agg(F.avg("sales").alias("avg_sales"))
    return g.groupBy(ORG).agg(
        F.count(F.lit(1)).alias("n_bands"),
        F.min_by(F.struct("band", "avg_sales"), F.struct(-F.col("avg_sales"), "_o")).alias("max_band"),
        F.min_by(F.struct("band", "avg_sales"), F.struct(F.col("avg_sales"), "_o")).alias("min_band"))


def holiday_numbers(fact: DataFrame) -> DataFrame:
    """Mean row sales on holidays vs other days and the uplift."""
    f = add_holiday_features(fact.select(ORG, "date", "sales"))
    a = f.groupBy(ORG).agg(
        F.sum("is_holiday").alias("holiday_rows"),
        F.avg(F.when(F.col("is_holiday") == 1, F.col("sales"))).alias("holiday_mean"),
        F.avg(F.when(F.col("is_holiday") == 0, F.col("sales"))).alias("other_mean"))
    a = a.withColumn("holiday_mean", F.when(F.col("holiday_rows") > 0, F.col("holiday_mean")).otherwise(0.0)) \
         .withColumn("other_mean", F.coalesce("other_mean", F.lit(1.0)))
    return a.withColumn("uplift_pct", F.when(F.col("other_mean") > 0,
                                             (F.col("holiday_mean") - F.col("other_mean")) / F.col("other_mean") * 100))


# ------------------------------------------------------------------- I10

def insights(fact: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Every insight sentence for every tenant."""
    o = overall_numbers(fact)
    parts = [
        _sentence(o, True, "overall", F.concat(
            F.lit("**Overview**: "), n0("items"), F.lit(" products across "), F.col("stores").cast("string"),
            F.lit(" stores over "), F.col("days").cast("string"), F.lit(" days. Total sales: **"), n0("total_sales"),
            F.lit("**. Average daily: **"), n0("avg_daily"), F.lit("**.")), "Summary"),
        _sentence(o, True, "revenue", F.concat(F.lit("**Revenue**: Estimated total revenue is **$"),
                                     F.format_number(F.coalesce("revenue", F.lit(0.0)), 2), F.lit("**.")), "Revenue"),
    ]
    t = trend_numbers(fact)
    ch = F.col("change_pct")
    parts.append(_sentence(t, (ch.isNotNull()), "trend", F.concat(
        F.when(ch > 0, "📈").otherwise("📉"), F.lit(" Sales are "),
        F.when(ch > 0, "increasing").otherwise("decreasing"), F.lit(" by **"), n1(F.abs(ch)),
        F.lit("%** in the last 7 days.")), "Trends"))
    parts.append(_sentence(t, (F.col("n_dow") > 1), "day_of_week", F.concat(
        F.lit("**Day-of-Week**: **"), _pick(DAY_NAMES, F.col("best_dow")), F.lit("** strongest, **"),
        _pick(DAY_NAMES, F.col("worst_dow")), F.lit("** weakest. Variation: **"),
        F.format_string("%.0f", "dow_spread_pct"), F.lit("%**.")), "Trends"))
    p = product_numbers(fact)
    names = F.array_join(F.transform("top3", lambda s: F.concat(F.lit("**"), s["item_id"], F.lit("** ("),
                                                                  F.format_number(s["units"], 0), F.lit(")"))), ", ")
    parts.append(_sentence(p, (F.col("n_items") >= 3), "top_products",
                       F.concat(F.lit("**Top Products**: "), names, F.lit(".")), "Products"))
    parts.append(_sentence(p, ((F.col("n_items") >= 3) & (F.col("top3_pct") > 50)), "concentration",
                       F.concat(F.lit("**High Concentration**: Top 3 account for **"), n1("top3_pct"),
                                F.lit("%** of sales.")), "Products", "warning"))
    parts.append(_sentence(p, (F.col("slow_movers") > 0), "slow_movers",
                       F.concat(F.lit("**Slow Movers**: **"), F.col("slow_movers").cast("string"),
                                F.lit("** products sell less than 10% of the median.")), "Products"))
    s = store_numbers(fact)
    parts.append(_sentence(s, (F.col("n_stores") >= 2), "store_performance", F.concat(
        F.lit("**Store Performance**: **"), F.col("top_store"), F.lit("** leads ("), n0("top_units"),
        F.lit("). Gap: **"), n1("ratio"), F.lit("x**.")), "Stores"))
    parts.append(_sentence(s, ((F.col("n_stores") >= 2) & (F.col("ratio") > 5)), "store_disparity", F.concat(
        F.lit("**Large Store Disparity**: Top store sells **"), n1("ratio"), F.lit("x** more than lowest.")),
        "Stores", "warning"))
    m = seasonality_numbers(fact)
    parts.append(_sentence(m, (F.col("n_months") >= 3), "seasonal_peak", F.concat(
        F.lit("**Seasonal Peak**: **"), _pick(MONTH_ABBR, F.col("peak.month") - 1), F.lit(" "),
        F.col("peak.year").cast("string"), F.lit("** highest ("), n0("peak.units"), F.lit("). Lowest: **"),
        _pick(MONTH_ABBR, F.col("low.month") - 1), F.lit(" "), F.col("low.year").cast("string"), F.lit("** ("),
        n0("low.units"), F.lit(").")), "Seasonality"))
    up = F.col("weekend_uplift_pct")
    parts.append(_sentence(m, (F.abs(up) > 10), "weekend_effect", F.concat(
        F.lit("**Weekend Effect**: "), F.when(up > 0, "Higher").otherwise("Lower"), F.lit(" by **"),
        F.format_string("%.0f", F.abs(up)), F.lit("%**.")), "Seasonality"))
    a = anomaly_numbers(fact)
    parts.append(_sentence(a, (F.col("n_high") > 0), "anomalies", F.concat(
        F.lit("**Anomalies**: **"), F.col("n_high").cast("string"), F.lit("** unusually high sales records ("),
        F.format_string("%.2f", "high_pct"), F.lit("%).")), "Data Quality", "warning"))
    se = season_numbers(fact)
    em = F.create_map(*[x for k, v in SEASON_EMOJI.items() for x in (F.lit(k), F.lit(v))])
    parts.append(_sentence(se, (F.col("n_seasons") >= 2), "season_performance", F.concat(
        F.lit("**Pakistan Season**: "), em[F.col("best.season")], F.lit(" **"), F.col("best.season"),
        F.lit("** highest ("), n0("best.sum"), F.lit("). "), em[F.col("worst.season")], F.lit(" **"),
        F.col("worst.season"), F.lit("** lowest ("), n0("worst.sum"), F.lit(").")), "Seasonality"))
    parts.append(_sentence(se, ((F.col("n_seasons") >= 2) & (F.col("ratio") > 1.5)), "season_variation", F.concat(
        F.lit("**High Seasonal Variation**: **"), n1("ratio"), F.lit("x** between peak and low seasons.")),
        "Seasonality", "warning"))
    wx = weather_numbers(fact, weather)
    parts.append(_sentence(wx, (F.col("n_bands") > 1), "weather_correlation", F.concat(
        F.lit("**Weather-Sales**: Highest at **"), F.col("max_band.band"), F.lit("** (avg "),
        F.format_string("%.0f", "max_band.avg_sales"), F.lit("), lowest at **"), F.col("min_band.band"),
        F.lit("** (avg "), F.format_string("%.0f", "min_band.avg_sales"), F.lit(").")), "Trends"))
    h = holiday_numbers(fact)
    hu = F.col("uplift_pct")
    parts.append(_sentence(h, (F.abs(hu) > 5), "holiday_impact", F.concat(
        F.lit("**Holiday Impact**: "), F.when(hu > 0, "Higher").otherwise("Lower"), F.lit(" by **"),
        n1(F.abs(hu)), F.lit("%** on holidays.")), "Seasonality"))
    return _tell(parts)


def latest_insights(table: DataFrame, n: int | None = None) -> DataFrame:
    """A18 / I10 daily job: the insight rows per tenant (the newest ``n`` if given)."""
    if n is None:
        return table
    w = Window.partitionBy(ORG).orderBy(F.desc("created_at"), "insight_type")
    return table.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# ------------------------------------------------------- growth helpers

def observed_growth(fact: DataFrame, keys: list[str], k: int = 28) -> DataFrame:
    """Sum of the last k observed daily totals vs the k before, per key (trap 2)."""
    d = daily(fact, keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    r = d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2 * k)
    g = r.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_rn") <= k, F.col("sales"))), F.lit(0.0)).alias("last_sum"),
        F.coalesce(F.sum(F.when((F.col("_rn") > k) & (F.col("_rn") <= 2 * k), F.col("sales"))), F.lit(0.0))
         .alias("prior_sum"))
    return g.withColumn("growth_pct", F.when(F.col("prior_sum") > 0,
                                             (F.col("last_sum") - F.col("prior_sum")) / F.col("prior_sum") * 100))


# --------------------------------------------------------------- I12 / I13

def _dow_stats(d: DataFrame, keys: list[str]) -> DataFrame:
    m = d.groupBy(*keys, C.weekday0("date").alias("dow")).agg(F.avg("sales").alias("m"))
    return m.groupBy(*keys).agg(
        F.when(F.avg("m") > 0, (F.max("m") - F.min("m")) / F.avg("m") * 100).otherwise(0.0).alias("dow_spread"),
        F.min_by("dow", F.struct(-F.col("m"), F.col("dow"))).alias("peak_dow"))


def store_intelligence(fact: DataFrame, weather: DataFrame | None = None, top_k: int = 5) -> DataFrame:
    """I12 for every (tenant, store)."""
    keys = [ORG, "store_id"]
    d = daily(fact, keys)
    base = fact.groupBy(*keys).agg(
        F.sum("sales").alias("total_sales"),
        F.sum(F.col("sales") * F.coalesce("sell_price", F.lit(0.0))).alias("revenue"),
        F.countDistinct("item_id").alias("products"), F.countDistinct("date").alias("days_covered"))
    items = fact.groupBy(*keys, "item_id").agg(F.avg("sales").alias("_m"), F.sum("sales").alias("units"),
                                               F.countDistinct("date").alias("_days"))
    vel = items.groupBy(*keys).agg(F.avg("_m").alias("velocity"))
    w = Window.partitionBy(*keys).orderBy(F.desc("units"), "item_id")
    best = (items.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= top_k)
                 .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
                     F.col("_rk").alias("rank"), "item_id", "units",
                     (F.col("units") / F.col("_days")).alias("avg_daily")))).alias("best_products")))
    wt = season_weather(d, "date", weather)  # C07: daily totals with the day's weather (table or season defaults)
    corr = (wt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("temp_c").alias("_ts"),
                                  F.corr("sales", "temp_c").alias("_c"))
              .select(*keys, F.when((F.col("_n") >= 10) & (F.col("_ts") > 0), rnd(F.col("_c"), 2))
                      .alias("weather_sensitivity")))
    g = observed_growth(fact, keys)
    out = (base.join(vel, keys).join(best, keys).join(_dow_stats(d, keys), keys).join(corr, keys)
               .join(g.select(*keys, "growth_pct"), keys))
    return out.select(
        *keys, rnd(F.col("total_sales"), 2).alias("total_sales"), rnd(F.col("revenue"), 2).alias("revenue"),
        "products", rnd(F.col("total_sales") / F.col("days_covered"), 2).alias("avg_daily_sales"),
        rnd(F.col("growth_pct"), 1).alias("growth_pct"), rnd(F.col("velocity"), 2).alias("sales_velocity"),
        "best_products", rnd(F.col("dow_spread"), 1).alias("day_of_week_spread_pct"),
        _pick(DAY_ABBR, F.col("peak_dow")).alias("peak_day"), "weather_sensitivity", "days_covered")


def product_intelligence(fact: DataFrame, accuracy: DataFrame | None = None) -> DataFrame:
    """I13 for every (tenant, item)."""
    keys = [ORG, "item_id"]
    d = daily(fact, keys)
    base = fact.groupBy(*keys).agg(
        F.first("category", ignorenulls=True).alias("category"),
        F.sum("sales").alias("total_sales"),
        F.sum(F.col("sales") * F.coalesce("sell_price", F.lit(0.0))).alias("revenue"),
        F.countDistinct("store_id").alias("stores"))
    st = fact.groupBy(*keys, "store_id").agg(F.sum("sales").alias("units"))
    top = st.groupBy(*keys).agg(F.min_by(F.struct("store_id", "units"),
                                         F.struct(-F.col("units"), F.col("store_id"))).alias("_top"))
    idx = d.withColumn("_i", (F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1).cast("double"))
    ds = idx.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days_covered"), F.avg("sales").alias("_mean"), F.stddev_samp("sales").alias("_sd"),
        F.regr_slope("sales", "_i").alias("_slope"))
    month = (d.groupBy(*keys, F.month("date").alias("m")).agg(F.avg("sales").alias("_ma"))
              .groupBy(*keys).agg(F.min_by("m", F.struct(-F.col("_ma"), F.col("m"))).alias("peak_month")))
    hol = holiday_calendar(fact).select(ORG, F.col("holiday_date").alias("date")).distinct().withColumn("_h",
                                                                                                        F.lit(1))
    # at most 21 holidays per tenant-year: a bounded dimension, broadcast into the daily series
    hd = d.join(F.broadcast(hol), [ORG, "date"], "left").withColumn("_h", F.coalesce("_h", F.lit(0)))
    hs = hd.groupBy(*keys).agg(F.sum("_h").alias("_nh"),
                               F.avg(F.when(F.col("_h") == 1, F.col("sales"))).alias("_ha"),
                               F.avg(F.when(F.col("_h") == 0, F.col("sales"))).alias("_ba"))
    hs = hs.select(*keys, F.when((F.col("_nh") >= 2) & (F.col("_ba") > 0),
                                 rnd((F.col("_ha") - F.col("_ba")) / F.col("_ba") * 100, 1))
                   .alias("holiday_sensitivity_pct"))
    g = observed_growth(fact, keys)
    out = (base.join(top, keys).join(ds, keys).join(month, keys).join(_dow_stats(d, keys), keys)
               .join(hs, keys).join(g.select(*keys, "growth_pct"), keys))
    cv = F.when((F.col("_mean") > 0) & (F.col("days_covered") > 1), F.col("_sd") / F.col("_mean")).otherwise(0.0)
    out = out.select(
        *keys, "category", rnd(F.col("total_sales"), 2).alias("total_sales"), rnd(F.col("revenue"), 2).alias("revenue"),
        "stores", rnd(F.col("total_sales") / F.col("days_covered"), 2).alias("avg_daily_sales"),
        rnd(F.col("growth_pct"), 1).alias("growth_pct"),
        F.when(F.col("days_covered") >= 2, rnd(F.col("_slope"), 3)).alias("trend_slope"),
        F.col("_top.store_id").alias("top_store"),
        F.when(F.col("total_sales") > 0, rnd(F.col("_top.units") / F.col("total_sales") * 100, 1)).alias("top_store_pct"),
        rnd(F.col("dow_spread"), 1).alias("day_of_week_spread_pct"), "peak_month",
        rnd(cv, 2).alias("demand_cv"),
        F.when(cv > 1.5, "high").when(cv > 0.8, "medium").otherwise("low").alias("stockout_risk"),
        "holiday_sensitivity_pct", "days_covered")
    if accuracy is not None:
        acc = accuracy.groupBy(ORG, F.col("product_id").alias("item_id")).agg(
            F.avg("wape").alias("accuracy_wape"), F.avg("mae").alias("accuracy_mae"),
            F.sum("eval_points").alias("accuracy_points"))
        out = out.join(acc, keys, "left")
    return out


# ------------------------------------------------------------------ I11

def executive_overview(fact: DataFrame, financials: DataFrame | None = None,
                       accuracy: DataFrame | None = None) -> DataFrame:
    """I11 scalar part: totals, growth (last 28 vs prior 28 observed days), financials."""
    base = tenant_totals(fact).select(ORG, F.col("sales").alias("total_sales"), "revenue", F.col("days").alias("days_covered"), F.col("items").alias("products"), "stores")
    g = observed_growth(fact, [ORG]).select(ORG, "growth_pct")
    out = base.join(g, ORG).select(
        ORG, rnd(F.col("total_sales"), 2).alias("total_sales"), rnd(F.col("revenue"), 2).alias("revenue"),
        rnd(F.col("total_sales") / F.col("days_covered"), 2).alias("avg_daily_sales"),
        rnd(F.col("growth_pct"), 1).alias("growth_pct"), "products", "stores", "days_covered")
    if accuracy is not None:
        a = accuracy.groupBy(ORG).agg(rnd(F.avg("wape"), 1).alias("forecast_accuracy_wape"))
        out = out.join(a, ORG, "left")
    if financials is not None:
        out = out.join(financials.select(
            ORG, rnd(F.col("total_inventory_value"), 2).alias("inventory_value"),
            rnd(F.col("total_overstock_capital"), 2).alias("overstock_capital"),
            rnd(F.col("total_potential_savings"), 2).alias("potential_savings")), ORG, "left")
    return out


def executive_risks(financials: DataFrame) -> DataFrame:
    """I11 risks from the financial summary (thresholds as in the reference)."""
    f = financials
    cap, loss, carry = F.col("total_overstock_capital"), F.col("total_stockout_loss_risk"), F.col("total_carrying_cost")
    r1 = f.filter(cap > 1000).select(ORG, F.lit("overstock_capital").alias("type"),
                                     F.when(cap > 10000, "high").otherwise("medium").alias("severity"),
                                     cap.alias("amount"),
                                     F.concat(F.lit("$"), n0(cap), F.lit(" tied up in overstock")).alias("message"),
                                     F.lit(0).alias("ord"))
    r2 = f.filter(loss > 500).select(ORG, F.lit("stockout_loss").alias("type"), F.lit("high").alias("severity"),
                                     loss.alias("amount"),
                                     F.concat(F.lit("$"), n0(loss), F.lit(" at risk from stockouts")).alias("message"),
                                     F.lit(1).alias("ord"))
    r3 = f.filter(carry > 1000).select(ORG, F.lit("carrying_cost").alias("type"), F.lit("low").alias("severity"),
                                       carry.alias("amount"),
                                       F.concat(F.lit("$"), n0(carry), F.lit(" annual carrying cost")).alias("message"),
                                       F.lit(2).alias("ord"))
    return r1.unionByName(r2).unionByName(r3)


def item_row_growth(fact: DataFrame, k: int = 28) -> DataFrame:
    """Per item: sum of its last k rows minus the k rows before (rows ordered by
    date then store — row based, as in the reference)."""
    w = Window.partitionBy(ORG, "item_id").orderBy(F.desc("date"), F.desc("store_id"))
    # rows beyond 2k never count: the filter lets Spark keep only the top 2k rows
    # per item in each task before the shuffle (WindowGroupLimit), so a hot item
    # spanning every store never lands whole in one task
    r = fact.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2 * k)
    return r.groupBy(ORG, "item_id").agg(
        (F.coalesce(F.sum(F.when(F.col("_rn") <= k, F.col("sales"))), F.lit(0.0))
         - F.coalesce(F.sum(F.when((F.col("_rn") > k) & (F.col("_rn") <= 2 * k), F.col("sales"))), F.lit(0.0)))
        .alias("growth_units"))


def executive_opportunities(fact: DataFrame, top_k: int = 3) -> DataFrame:
    """I11 opportunities: the top growing items (positive growth only)."""
    g = item_row_growth(fact)
    w = Window.partitionBy(ORG).orderBy(F.desc("growth_units"), "item_id")
    t = g.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= top_k) & (F.col("growth_units") > 0))
    return t.select(ORG, "rank", F.lit("product_growth").alias("type"), "item_id",
                    F.col("growth_units").alias("units"),
                    F.concat(F.col("item_id"), F.lit(" growing (+"), F.format_string("%.0f", "growth_units"),
                             F.lit(" units vs prior month)")).alias("message"))


def executive_actions(alerts: DataFrame | None, financials: DataFrame, overview: DataFrame,
                      max_alerts: int | None = None) -> DataFrame:
    """I11 prioritised actions: alerts (the newest ``max_alerts`` if given), reorder action, revenue decline; by
    priority, alerts first and newest first among equals."""
    parts, none = [], [F.lit(None).cast("string").alias("_made"), F.lit(None).cast("string").alias("_key")]
    if alerts is not None:
        a = alerts
        if max_alerts is not None:
            w = Window.partitionBy(ORG).orderBy(F.desc("created_at"), "dedup_key")
            a = a.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_alerts)
        parts.append(a.select(ORG, F.when(F.col("severity").isin("critical", "high"), 1).otherwise(2).alias("priority"),
                              F.col("alert_type").alias("type"), "title", F.col("message").alias("detail"),
                              "severity", F.lit(0).alias("_seq"), F.col("created_at").cast("string").alias("_made"), F.col("dedup_key").alias("_key")))
    f = financials.filter(F.col("items_to_reorder") > 0)
    parts.append(f.select(ORG, F.lit(2).alias("priority"), F.lit("reorder").alias("type"),
                          F.concat(F.col("items_to_reorder").cast("string"), F.lit(" items need reordering")).alias("title"),
                          F.concat(F.lit("Estimated order value $"), n0("total_recommended_order_value")).alias("detail"),
                          F.lit("medium").alias("severity"), F.lit(1).alias("_seq"), *none))
    o = overview.filter(F.col("growth_pct") < -10)
    parts.append(o.select(ORG, F.lit(1).alias("priority"), F.lit("revenue_decline").alias("type"),
                          F.concat(F.lit("Revenue down "), F.format_string("%.0f", F.abs("growth_pct")),
                                   F.lit("% month-over-month")).alias("title"),
                          F.lit("Investigate demand shifts, stockouts, or pricing before it compounds.").alias("detail"),
                          F.lit("high").alias("severity"), F.lit(2).alias("_seq"), *none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = ["priority", "_seq", F.desc("_made"), "_key"]
    return split_rank(out, [ORG], order, "position").drop("_seq", "_made", "_key")


# ------------------------------------------------------------ I15 / I16 / I17

def sales_summary(fact: DataFrame) -> DataFrame:
    """I16 sales summary per tenant."""
    g = observed_growth(fact, [ORG])
    a = tenant_totals(fact).select(ORG, F.col("items").alias("total_products"), F.col("stores").alias("total_stores"), F.col("days").alias("days_covered"),
                                   F.col("sales").alias("_total"), F.col("avg_daily").alias("_avg"))
    return a.join(g, ORG).select(
        ORG, "total_products", "total_stores", "days_covered", rnd(F.col("_total"), 2).alias("total_sales"),
        rnd(F.col("_avg"), 2).alias("avg_daily_sales"), rnd(F.col("last_sum"), 2).alias("last_28d_sales"),
        rnd(F.col("prior_sum"), 2).alias("prior_28d_sales"), rnd(F.col("growth_pct"), 1).alias("growth_pct"))


def auto_summary(overview: DataFrame, financials: DataFrame | None, risks: DataFrame | None = None,
                 actions: DataFrame | None = None) -> DataFrame:
    """The management summary sentence per tenant, next to its numbers."""
    o = overview
    if financials is not None:
        o = o.join(financials.select(ORG, "total_inventory_value", "total_overstock_capital",
                                     "total_stockout_loss_risk"), ORG, "left")
    if risks is not None:
        rk = risks.groupBy(ORG).agg(F.sort_array(F.collect_list(F.struct("ord", "message"))).alias("_r"))
        o = o.join(rk, ORG, "left")
    if actions is not None:
        ac = actions.groupBy(ORG).agg(F.sort_array(F.collect_list(F.struct("position", "title"))).alias("_a"))
        o = o.join(ac, ORG, "left")
    g = F.col("growth_pct")
    parts = [
        F.when(g.isNotNull(), F.concat(F.lit("Sales "), F.when(g >= 0, "grew").otherwise("declined"), F.lit(" "),
                                       n1(F.abs(g)), F.lit("% month-over-month ("), n0("total_sales"),
                                       F.lit(" units total).")))
         .otherwise(F.concat(F.lit("Total sales "), n0("total_sales"), F.lit(" units."))),
        F.when(F.col("revenue").isNotNull(), F.concat(F.lit("Estimated revenue "), n0("revenue"), F.lit("."))),
    ]
    if financials is not None:
        parts.append(F.when(F.col("total_inventory_value").isNotNull(), F.concat(
            F.lit("Inventory value "), n0("total_inventory_value"), F.lit(" with "), n0("total_overstock_capital"),
            F.lit(" tied up in overstock and "), n0("total_stockout_loss_risk"), F.lit(" at stockout risk."))))
    if "forecast_accuracy_wape" in o.columns:
        parts.append(F.when(F.col("forecast_accuracy_wape").isNotNull(), F.concat(
            F.lit("Forecast accuracy (WAPE) "), n1("forecast_accuracy_wape"), F.lit("%."))))
    if risks is not None:
        parts.append(F.when(F.size("_r") > 0, F.concat(F.lit("Key risks: "), F.array_join(
            F.transform(F.slice("_r", 1, 3), lambda x: x["message"]), "; "), F.lit("."))))
    if actions is not None:
        parts.append(F.when(F.size("_a") > 0, F.concat(F.lit("Priority actions: "), F.array_join(
            F.transform(F.slice("_a", 1, 4), lambda x: x["title"]), "; "), F.lit("."))))
    return o.select(ORG, "total_sales", "growth_pct", F.concat_ws(" ", *parts).alias("summary"))


# Fixed values that must equal the reference's: the words that name an intent.
INTENTS = {
    "decline": ["why", "declin", "drop", "down", "decreas"],
    "reorder": ["reorder", "order", "stock up", "purchase", "buy"],
    "stores": ["store", "underperform", "perform", "branch", "location"],
    "demand": ["demand", "increase", "growth", "trend", "upcoming", "popular"],
}


def intent(name: str, question: str = "question") -> Column:
    """Whether a question holds one of an intent's words."""
    q = F.lower(question)
    return reduce(lambda a, b: a | b, [q.contains(word) for word in INTENTS[name]])


def question_intents(questions: DataFrame) -> DataFrame:
    """The intents of questions, from their text alone."""
    return questions.select(ORG, "question_id", *[intent(name).alias(f"intent_{name}") for name in ("decline", "reorder", "stores", "demand")])


def _first(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key, numbered ``_rk``."""
    return df.withColumn("_rk", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rk") <= k)


def answer_questions(questions: DataFrame, summary: DataFrame, financials: DataFrame,
                     decisions: DataFrame, stores: DataFrame, products: DataFrame, alerts: DataFrame | None = None,
                     top_k: int | None = None) -> DataFrame:
    """Rule-based answers for a batch of question rows ``(organization_id, question_id, question)``.

    Each tenant's snapshot (sales summary, financials, reorder items, stores,
    products and open alerts; of stores and products the ``top_k`` largest if
    given) is built once as a single row per tenant and joined
    to its questions on the tenant key; intents are keyword tests on the
    lower-cased question, lines are templated and joined with newlines.
    """
    w_re = Window.partitionBy(ORG).orderBy(F.desc("recommended_order_qty"), "item_id", "store_id")
    re_ = (decisions.withColumn("_rk", F.row_number().over(w_re)).filter(F.col("_rk") <= 5)
           .groupBy(ORG).agg(F.sort_array(F.collect_list(F.struct(
               "_rk", "item_id", "store_id", "recommended_order_qty", "stockout_in_days", "days_of_stock"))).alias("reorder")))
    # the answers name the first three or five of each list: every window below is cut to those, so no tenant's rows meet in one task
    by_store, by_item = [F.desc("total_sales"), "store_id"], [F.desc("total_sales"), "item_id"]
    st = stores if top_k is None else _first(stores, [ORG], by_store, top_k).drop("_rk")
    best = _first(st, [ORG], by_store, 3).groupBy(ORG).agg(F.sort_array(F.collect_list(
        F.struct("_rk", "store_id", "total_sales"))).alias("best_stores"))
    worst = (_first(st, [ORG], [F.coalesce("growth_pct", F.lit(0.0)), *by_store], 3).filter(F.col("growth_pct").isNotNull())
             .groupBy(ORG).agg(F.sort_array(F.collect_list(F.struct("_rk", "store_id", "growth_pct"))).alias("weak_stores")))
    pr = products if top_k is None else _first(products, [ORG], by_item, top_k).drop("_rk")
    kind = F.when(F.col("growth_pct") < -10, "declining").when(F.col("growth_pct") > 10, "growing")
    first = _first(pr.withColumn("_kind", kind).filter("_kind is not null"), [ORG, "_kind"], by_item, 5)
    prod = first.groupBy(ORG).agg(
        F.sort_array(F.collect_list(F.when(F.col("_kind") == "declining", F.struct("_rk", "item_id")))).alias("declining"),
        F.sort_array(F.collect_list(F.when(F.col("_kind") == "growing", F.struct("_rk", "item_id", "growth_pct"))))
         .alias("growing"))
    snap = (summary.join(financials, ORG, "left").join(re_, ORG, "left").join(best, ORG, "left")
                   .join(worst, ORG, "left").join(prod, ORG, "left"))
    if alerts is None:
        snap = snap.withColumn("alert_titles", F.lit(None).cast("array<string>"))
    else:
        w_al = Window.partitionBy(ORG).orderBy(F.desc("created_at"), "title")
        three = alerts.withColumn("_n", F.row_number().over(w_al)).filter("_n <= 3")
        titles = three.groupBy(ORG).agg(F.sort_array(F.collect_list(F.struct("_n", "title"))).alias("_t"))
        snap = snap.join(titles.select(ORG, F.col("_t.title").alias("alert_titles")), ORG, "left")
    # one row per tenant, up to the bound: a hot tenant's questions stay where they are
    q = questions.join(checked_broadcast(materialize(snap, "snapshot")), ORG, "left")

    g = F.col("growth_pct")
    dec, reo, sto, dem = (intent(name) for name in ("decline", "reorder", "stores", "demand"))
    reorder_lines = F.transform("reorder", lambda r: F.concat(
        F.lit("  - "), r["item_id"], F.lit(" @ "), r["store_id"], F.lit(": order "),
        F.format_string("%.0f", r["recommended_order_qty"]), F.lit(" units ("),
        F.format_string("%.0f", F.coalesce(r["days_of_stock"], F.lit(0.0))), F.lit("d of stock"),
        F.when(r["stockout_in_days"].isNotNull(),
               F.concat(F.lit(", runs out in "), F.format_string("%.0f", r["stockout_in_days"]), F.lit("d")))
         .otherwise(F.lit("")), F.lit(")")))
    lines = F.array(
        F.when(dec, F.when(g.isNotNull() & (g < 0), F.concat(
            F.lit("Sales are down "), n1(F.abs(g)), F.lit("% over the last 28 days vs the prior 28 (last 28d: "),
            F.col("last_28d_sales").cast("string"), F.lit(", prior: "), F.col("prior_28d_sales").cast("string"),
            F.lit(").")))
            .when(g.isNotNull(), F.concat(F.lit("Sales are up "), n1(g),
                                          F.lit("% over the last 28 days — no decline detected.")))
            .otherwise(F.lit("Not enough history to assess a decline."))),
        F.when(dec & (F.size(F.coalesce("declining", F.array())) > 0), F.concat(
            F.lit("Likely drivers — products with sharp drops: "),
            F.array_join(F.transform(F.slice("declining", 1, 5), lambda x: x["item_id"]), ", "))),
        F.when(dec & F.col("alert_titles").isNotNull(), F.concat(
            F.lit("Open alerts that may relate: "), F.array_join("alert_titles", "; "))),
        F.when(reo, F.when(F.size(F.coalesce("reorder", F.array())) > 0, F.concat_ws(
            "\n", F.lit("Recommended reorders (top by quantity):"), F.array_join(reorder_lines, "\n")))
            .otherwise(F.lit("No urgent reorders detected."))),
        F.when(reo & F.col("total_inventory_value").isNotNull(), F.concat(
            F.lit("Financials: $"), n0("total_inventory_value"), F.lit(" inventory, $"), n0("total_overstock_capital"),
            F.lit(" overstock, $"), n0("total_stockout_loss_risk"), F.lit(" stockout risk, $"),
            n0("total_potential_savings"), F.lit(" potential savings."))),
        F.when(sto & F.col("best_stores").isNotNull(), F.concat(F.lit("Top stores by sales: "), F.array_join(
            F.transform("best_stores", lambda s: F.concat(s["store_id"], F.lit(" ($"), n0(s["total_sales"]), F.lit(")"))),
            ", "))),
        F.when(sto & F.col("best_stores").isNotNull(), F.concat(F.lit("Stores with weakest growth: "), F.array_join(
            F.transform(F.coalesce("weak_stores", F.array()), lambda s: F.concat(
                s["store_id"], F.lit(" ("), s["growth_pct"].cast("string"), F.lit("%)"))), ", "))),
        F.when(dem, F.when(F.size(F.coalesce("growing", F.array())) > 0, F.concat(
            F.lit("Products with rising demand: "), F.array_join(F.transform(F.slice("growing", 1, 5), lambda p: F.concat(
                p["item_id"], F.lit(" (+"), F.format_string("%.0f", p["growth_pct"]), F.lit("%)"))), ", ")))
            .otherwise(F.lit("No products with strong recent demand growth detected."))),
    )
    fallback = F.concat_ws("\n", F.concat(
        F.lit("This business has "), F.coalesce(F.col("total_products"), F.lit(0)).cast("string"),
        F.lit(" products across "), F.coalesce(F.col("total_stores"), F.lit(0)).cast("string"),
        F.lit(" stores over "), F.coalesce(F.col("days_covered"), F.lit(0)).cast("string"), F.lit(" days ("),
        n0(F.coalesce(F.col("total_sales"), F.lit(0.0))), F.lit(" total sales).")),
        F.when(F.col("total_inventory_value").isNotNull(), F.concat(
            F.lit("Inventory value $"), n0("total_inventory_value"), F.lit("; "),
            F.col("items_to_reorder").cast("string"), F.lit(" items need reordering."))),
        F.when(F.col("alert_titles").isNotNull(), F.concat(F.lit("Open alerts: "), F.array_join("alert_titles", "; "))))
    body = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    any_intent = dec | reo | sto | dem
    return q.select(ORG, "question_id", "question",
                    dec.alias("intent_decline"), reo.alias("intent_reorder"), sto.alias("intent_stores"),
                    dem.alias("intent_demand"),
                    F.when(any_intent, body).otherwise(fallback).alias("answer"))


# ------------------------------------------------------------ I14 / I16

def business_snapshot(fact: DataFrame, decisions: DataFrame, financials: DataFrame,
                      stores: DataFrame, products: DataFrame, alerts: DataFrame | None = None,
                      accuracy: DataFrame | None = None, top_k: int | None = None) -> dict[str, DataFrame]:
    """I16: the named frames of a tenant snapshot — every tenant at once, each
    list ranked, and cut to its top ``top_k`` per tenant if given."""
    def top(df, order, k=top_k):
        return split_rank(df, [ORG], order) if k is None else _first(df, [ORG], order, k).withColumnRenamed("_rk", "rank")

    out = {
        "sales": sales_summary(fact),
        "financials": financials,
        "top_reorder_items": top(decisions.select(ORG, "item_id", "store_id", "recommended_order_qty",
                                                  "stockout_in_days", "overstock_capital", "inventory_value",
                                                  "days_of_stock"),
                                 [F.desc("recommended_order_qty"), "item_id", "store_id"]),
        "stockout_risks": top(decisions.filter(F.col("stockout_in_days").isNotNull())
                              .select(ORG, "item_id", "store_id", "stockout_in_days"),
                              ["stockout_in_days", "item_id", "store_id"]),
        "stores": top(stores, [F.desc("total_sales"), "store_id"]),
        "products": top(products, [F.desc("total_sales"), "item_id"]),
    }
    if alerts is not None:
        out["alerts"] = top(alerts.select(ORG, "alert_type", "severity", "title", "created_at"),
                            [F.desc("created_at"), "title"])
    if accuracy is not None:
        out["forecast_accuracy"] = top(accuracy, ["horizon_days", "product_id", "store_id"])
    return out


def report_payload(fact: DataFrame, decisions: DataFrame, financials: DataFrame,
                   accuracy: DataFrame | None = None, registry: DataFrame | None = None,
                   max_decisions: int | None = None, max_accuracy: int | None = None) -> dict[str, DataFrame]:
    """Report frames — decisions (largest orders first), financials,
    executive overview and summary sentence, active model, accuracy."""
    def ranked(df, order, most):
        return split_rank(df, [ORG], order) if most is None else _first(df, [ORG], order, most).withColumnRenamed("_rk", "rank")

    dec = ranked(decisions, [F.desc("recommended_order_qty"), "item_id", "store_id"], max_decisions)
    ov = executive_overview(fact, financials, accuracy)
    out = {"decisions": dec, "financials": financials, "executive": ov,
           "summary": auto_summary(ov, financials, executive_risks(financials),
                                   executive_actions(None, financials, ov))}
    if registry is not None:
        out["active_model"] = registry.filter(F.col("status") == "active")
    if accuracy is not None:
        out["accuracy"] = ranked(accuracy, ["horizon_days", "product_id", "store_id"], max_accuracy)
    return out
