"""Feature engineering (E01-E14) for demand models.

Series features (lags, rolling stats, price diffs) share one window spec,
``partitionBy(tenant, item, store).orderBy(date)``, and are computed in one
``select`` so the plan has a single exchange + sort. A series holds at most one
row per day, so window partitions stay bounded however large a tenant is.
The per-item price mean (E09) spans stores, so it is a grouped aggregate joined
back rather than a window (a hot item would otherwise land in one task).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import calendar as C
from tillsight.functions.core import ORG, dealt
from tillsight.operators.calendar import holiday_date_features, holiday_names, season_weather

SERIES = [ORG, "item_id", "store_id"]
LAGS = (1, 7, 14, 28)
WINDOWS = (7, 14, 28)
SEASON_NAMES = ("Spring", "Summer", "Monsoon", "Autumn", "Winter")


def series_window(order: str = "date") -> Window:
    return Window.partitionBy(*SERIES).orderBy(order)


def time_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Calendar parts; day of week Monday = 0; ISO week."""
    d = F.col(date_col)
    return df.withColumns({
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d),
        "dayofweek": C.weekday0(d), "dayofyear": F.dayofyear(d),
        "week": F.weekofyear(d), "quarter": F.quarter(d),
        "is_weekend": (C.weekday0(d) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
    })


def season_features(df: DataFrame, date_col: str = "date", with_doy: bool = True) -> DataFrame:
    """E02 (E02b without day-of-year terms): season label, one-hot, cyclic terms."""
    d = F.col(date_col)
    two_pi = 2 * math.pi
    cols = {"pakistan_season": C.season(d)}
    out = df.withColumns(cols)
    onehot = {f"season_{s}": (F.col("pakistan_season") == s).cast("int") for s in SEASON_NAMES}
    cyc = {
        "month_sin": F.sin(two_pi * F.month(d) / 12), "month_cos": F.cos(two_pi * F.month(d) / 12),
        "dow_sin": F.sin(two_pi * C.weekday0(d) / 7), "dow_cos": F.cos(two_pi * C.weekday0(d) / 7),
    }
    if with_doy:
        cyc.update({"doy_sin": F.sin(two_pi * F.dayofyear(d) / 365),
                    "doy_cos": F.cos(two_pi * F.dayofyear(d) / 365)})
    return out.withColumns({**onehot, **cyc})


def weather_features(df: DataFrame, date_col: str = "date", weather: DataFrame | None = None) -> DataFrame:
    """Weather columns (table or season defaults) and threshold flags."""
    w = season_weather(df, date_col, weather)
    if "season" in w.columns and "season" not in df.columns:
        w = w.drop("season")
    return w.withColumns({
        "is_extreme_heat": (F.col("temp_c") >= 35).cast("int"),
        "is_cold_wave": (F.col("temp_c") <= 10).cast("int"),
        "is_comfortable_temp": ((F.col("temp_c") >= 20) & (F.col("temp_c") <= 30)).cast("int"),
        "is_high_humidity": (F.col("humidity_pct") >= 70).cast("int"),
        "is_low_humidity": (F.col("humidity_pct") <= 30).cast("int"),
        "is_rainy": (F.col("rain_mm") > 5).cast("int"),
        "is_heavy_rain": (F.col("rain_mm") > 20).cast("int"),
    })


def season_weather_interactions(df: DataFrame) -> DataFrame:
    """Season × weather interaction flags."""
    s, t = F.col("pakistan_season"), F.col("temp_c")
    cols = {"hot_summer": ((s == "Summer") & (t >= 35)).cast("int"),
            "cold_winter": ((s == "Winter") & (t <= 10)).cast("int"),
            "rainy_monsoon": ((s == "Monsoon") & (F.col("rain_mm") > 10)).cast("int")}
    if "in_ramadan_window" in df.columns:
        cols["hot_ramadan"] = ((F.col("in_ramadan_window") == 1) & (t >= 35)).cast("int")
    return df.withColumns(cols)


def demand_indicators(df: DataFrame) -> DataFrame:
    """Pre-holiday shopping, holiday pressure, weekend × season."""
    d = F.col("days_to_holiday")
    return df.withColumns({
        "is_pre_holiday_shopping": ((F.col("in_ramadan_window") == 1) | (F.col("in_eid_window") == 1)).cast("int"),
        "holiday_pressure": F.when(d <= 30, F.greatest(F.lit(0.0), 1 - d / 30.0)).otherwise(F.lit(0.0)),
        "weekend_in_summer": ((F.col("is_weekend") == 1) & (F.col("pakistan_season") == "Summer")).cast("int"),
        "weekend_in_winter": ((F.col("is_weekend") == 1) & (F.col("pakistan_season") == "Winter")).cast("int"),
    })


def lag_columns(target: str = "sales", lags=LAGS) -> dict:
    w = series_window()
    return {f"{target}_lag_{n}": F.lag(target, n).over(w) for n in lags}


def price_columns() -> dict:
    w = series_window()
    p = F.col("sell_price")
    return {"price_change": p - F.lag(p, 1).over(w), "price_momentum": p - F.lag(p, 7).over(w)}


def by_series(df: DataFrame) -> DataFrame:
    """``df`` dealt by series: what a window's task sorts does not grow with the table."""
    return dealt(df, SERIES, df.count())


def lag_features(df: DataFrame, target: str = "sales", lags=LAGS) -> DataFrame:
    """Lags by rows within each series."""
    return by_series(df).withColumns(lag_columns(target, lags))


def rolling_features(df: DataFrame, target: str = "sales", windows=WINDOWS) -> DataFrame:
    """Rolling mean / sample std / max / min over the last n rows incl. current.

    No frame slides: sums are differences of running sums (of values less the series' first one, so that little
    cancels), and the extreme of n rows is that of the extremes of overlapping blocks of about the square root
    of n rows, read by their offsets. Three window steps share one exchange and sort.
    """
    return _rolled(by_series(df).withColumns(_rolling_start(target, windows)), target, windows)


_EXTREMES = (("max", F.greatest), ("min", F.least))


def _block(windows) -> int:
    return max(1, math.isqrt(max(windows, default=1)))


def _rolling_start(target: str, windows) -> dict:
    w = series_window()
    y = F.col(target).cast("double")
    out = {"_origin": F.first(y, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    for n in {_block(windows), *[n for n in windows if n < _block(windows)]}:
        out |= {f"_{k}_{n}": f(y, *[F.lag(y, i).over(w) for i in range(1, n)]) if n > 1 else y for k, f in _EXTREMES}
    return out


def _rolled(df: DataFrame, target: str, windows) -> DataFrame:
    """``rolling_features`` after ``_rolling_start``'s columns."""
    w, block = series_window(), _block(windows)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col(target).cast("double") - F.col("_origin")
    steps = {"_s1": F.coalesce(F.sum(v).over(running), F.lit(0.0)), "_s2": F.coalesce(F.sum(v * v).over(running), F.lit(0.0)),
             "_n": F.count(target).over(running)}
    for n in windows:
        for k, f in _EXTREMES:
            at = sorted({*range(0, n - block + 1, block), n - block} - {0})  # how far back the blocks start
            steps[f"_{k}_of_{n}"] = F.col(f"_{k}_{n}") if n <= block else f(*[F.col(f"_{k}_{block}"), *[F.lag(f"_{k}_{block}", i).over(w) for i in at]])
    out = df.withColumns(steps)
    last = lambda c, n: F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0))
    steps = {}
    for n in windows:
        count, total, squares = last("_n", n), last("_s1", n), last("_s2", n)
        steps[f"{target}_rolling_mean_{n}"] = F.when(count > 0, F.col("_origin") + total / count)
        steps[f"{target}_rolling_std_{n}"] = F.when(count > 1, F.sqrt(F.greatest((squares - total * total / count) / (count - 1), F.lit(0.0))))
        steps |= {f"{target}_rolling_{k}_{n}": F.col(f"_{k}_of_{n}") for k, _ in _EXTREMES}
    out = out.withColumns(steps)
    return out.drop(*[c for c in out.columns if c in ("_origin", "_s1", "_s2", "_n") or c.startswith(("_max_", "_min_"))])


def item_price_mean(df: DataFrame) -> DataFrame:
    return df.groupBy(ORG, "item_id").agg(F.avg("sell_price").alias("_item_price_mean"))


def _stored_item_prices(df: DataFrame) -> DataFrame:
    """``item_price_mean``, stored: its size is known, so a small one is sent to the rows."""
    from tillsight.sources.tables import materialize
    return materialize(item_price_mean(df), "item-prices")


def price_features(df: DataFrame) -> DataFrame:
    """Price change, price vs the item's mean over all stores, 7-row momentum."""
    out = by_series(df).withColumns(price_columns())
    out = out.join(_stored_item_prices(df), [ORG, "item_id"], "left").select(*df.columns, "_item_price_mean", "price_change", "price_momentum")
    return out.withColumn("price_vs_avg", F.col("sell_price") - F.col("_item_price_mean")).drop("_item_price_mean")


def date_features(df: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """E01, E02, E03-E06 once per tenant and day: calendar parts, seasons, weather, holidays, interactions, indicators."""
    dates = df.select(ORG, "date").distinct()
    out = weather_features(season_features(time_features(dates)), weather=weather)
    out = out.join(holiday_date_features(dates), [ORG, "date"], "left")
    return demand_indicators(season_weather_interactions(out))


def all_features(df: DataFrame, weather: DataFrame | None = None, target: str = "sales", stored: bool = False) -> DataFrame:
    """Every feature.

    The series windows (lags, rolling stats, price diffs) run first, on the
    narrow fact rows, sharing one exchange + sort. What depends on the tenant and
    day alone is derived once per day, stored (tenants × calendar days) and
    joined, so that no row of the fact computes it again. ``stored``: the series' features are stored too, for
    a frame that is read more than once; the days' join them at each reading, as writing and reading their many columns costs more.
    """
    from tillsight.sources.tables import materialize
    out = _rolled(by_series(df).withColumns({**price_columns(), **lag_columns(target), **_rolling_start(target, WINDOWS)}), target, WINDOWS)
    out = out.join(_stored_item_prices(df), [ORG, "item_id"], "left")
    out = out.withColumn("price_vs_avg", F.col("sell_price") - F.col("_item_price_mean")).drop("_item_price_mean")
    if stored:
        out = materialize(out, "series-features")
    dates = materialize(df.select(ORG, "date").distinct(), "dates")
    out = out.join(materialize(date_features(dates, weather), "date-features"), [ORG, "date"], "left")
    return out.select(*df.columns, *[c for c in out.columns if c not in df.columns])


NON_FEATURES = {"organization_id", "item_id", "store_id", "date", "category", "pakistan_season", "season",
                "weather_condition", "weather_description"}


def feature_profile(df: DataFrame, target: str = "sales", exclude=()) -> DataFrame:
    """Which numeric columns qualify as model features.

    A column qualifies when it is numeric, not excluded, not all NULL and has
    more than one distinct value — tested exactly, in one pass, as
    ``min < max`` over its non-NULL values (no distinct-count needed).
    """
    from pyspark.sql import types as T
    skip = set(NON_FEATURES) | {target} | set(exclude)
    num = [f.name for f in df.schema.fields
           if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    aggs = []
    for c in num:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.min(x).alias(f"{c}__lo"), F.max(x).alias(f"{c}__hi")]
    row = df.agg(*aggs)
    stacks = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(f"{c}__n").alias("n_non_null"),
                       (F.col(f"{c}__lo") < F.col(f"{c}__hi")).alias("varies"))
              for i, c in enumerate(num)]
    out = row.select(F.explode(F.array(*stacks)).alias("s")).select("s.*")
    return out.withColumn("selected", (F.col("n_non_null") > 0) & F.coalesce(F.col("varies"), F.lit(False)))


def select_features(df: DataFrame, target: str = "sales", exclude=()) -> list[str]:
    """E11 as a list (one small aggregate action); NULL features then filled with 0 by the caller."""
    prof = feature_profile(df, target, exclude).filter("selected").orderBy("position")
    return [r["feature"] for r in prof.select("feature").collect()]


def last_vs_prior(df: DataFrame, keys: list[str], value: str, k: int, order: str = "date") -> DataFrame:
    """Per group, sum of the last k rows and of the k rows before them (by ``order``).

    ``prior_rows`` tells whether the prior block is complete; callers decide
    what a short history means (NULL growth in the reference).
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    r = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2 * k)
    return r.groupBy(*keys).agg(
        F.sum(F.when(F.col("_rn") <= k, F.col(value))).alias("last_sum"),
        F.sum(F.when((F.col("_rn") > k) & (F.col("_rn") <= 2 * k), F.col(value))).alias("prior_sum"),
        F.count(F.when(F.col("_rn") <= k, 1)).alias("last_rows"),
        F.count(F.when((F.col("_rn") > k) & (F.col("_rn") <= 2 * k), 1)).alias("prior_rows"))


def day_index(df: DataFrame, keys: list[str], order: str = "date", name: str = "day_idx") -> DataFrame:
    """0-based position of each row within its group (for trend slopes)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def event_flags(df: DataFrame, date_col: str = "date") -> DataFrame:
    """has_event / event_type from the holiday calendar (the test tables carry
    no event or SNAP columns; a ``state_id`` + ``snap_*`` frame can add SNAP)."""
    n = holiday_names(df, date_col)
    out = n.withColumns({"has_event": F.col("holiday_name").isNotNull().cast("int"),
                         "event_type": F.when(F.col("holiday_name").isNotNull(),
                                              C.holiday_category("holiday_name"))})
    if "state_id" in df.columns and all(c in df.columns for c in ("snap_CA", "snap_TX", "snap_WI")):
        out = out.withColumn("snap", F.when(F.col("state_id") == "CA", F.col("snap_CA"))
                             .when(F.col("state_id") == "TX", F.col("snap_TX"))
                             .when(F.col("state_id") == "WI", F.col("snap_WI")).otherwise(0))
    return out
