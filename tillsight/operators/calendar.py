"""Holiday, season and weather operators.

The holiday calendar is tiny and bounded (at most 21 rows per tenant-year), so
range and as-of joins are turned into equi joins by exploding each holiday to
the dates it affects (its pre-holiday window, or the 0..90 days it is
"nearest" for). The fact side then needs one equi join on ``(tenant, date)``
against a per-date dimension whose size is bounded by tenants × calendar days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.functions import calendar as C
from tillsight.functions.core import ORG, as_date, per_tenant

LOOKAHEAD_DAYS = 90
NO_HOLIDAY_DISTANCE = 30


def _fixed_array() -> F.Column:
    return F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("name"))
                     for m, d, n in C.FIXED_HOLIDAYS])


_CONST: dict = {}


def _constant(spark: SparkSession, name: str, build) -> DataFrame:
    """A fixed lookup table, created once per session (it is a literal table)."""
    key = (id(spark), name)
    df = _CONST.get(key)
    if df is None or df.sparkSession is not spark:
        df = build()
        _CONST[key] = df
    return df


def islamic_table(spark: SparkSession) -> DataFrame:
    def build():
        rows = [(y, n, d) for y, items in C.ISLAMIC_HOLIDAYS.items() for n, d in items]
        return (spark.createDataFrame(rows, "table_year int, name string, d string")
                     .select("table_year", "name", F.to_date("d").alias("holiday_date")))
    return _constant(spark, "islamic", build)


def holidays_for_years(years: DataFrame) -> DataFrame:
    """holidays of each ``(organization_id, year)`` row, one per date within a year.

    Fixed holidays come from exploding a literal array (no join); the Islamic
    table (65 fixed rows) is joined by year. A date listed twice in one year
    keeps the fixed holiday.
    """
    spark = years.sparkSession
    fixed = (years.select(ORG, "year", F.explode(_fixed_array()).alias("h"))
                  .select(ORG, F.col("year").alias("table_year"), F.col("h.name").alias("name"),
                          F.make_date("year", "h.m", "h.d").alias("holiday_date"),
                          F.lit(0).alias("_prio")))
    isl = (years.join(F.broadcast(islamic_table(spark)), years.year == F.col("table_year"))
                .select(ORG, "table_year", "name", "holiday_date", F.lit(1).alias("_prio")))
    allh = fixed.unionByName(isl)
    w = Window.partitionBy(ORG, "table_year", "holiday_date").orderBy("_prio", "name")
    h = allh.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_prio")
    cat = C.holiday_category("name")
    return (h.withColumn("category", cat)
             .withColumn("demand_multiplier", C.holiday_multiplier(F.col("category")))
             .withColumn("pre_days", C.holiday_pre_days(F.col("category")))
             .withColumn("advice", C.holiday_advice(F.col("category"))))


def tenant_years(frame: DataFrame, date_col: str = "date", pad_next: bool = False) -> DataFrame:
    """Years spanned by each tenant's dates (optionally plus the following year)."""
    r = frame.groupBy(ORG).agg(F.min(F.year(date_col)).alias("_y0"), F.max(F.year(date_col)).alias("_y1"))
    hi = F.col("_y1") + 1 if pad_next else F.col("_y1")
    return r.select(ORG, F.explode(F.sequence("_y0", hi)).alias("year"))


def holiday_calendar(frame: DataFrame, date_col: str = "date") -> DataFrame:
    """the holiday dimension for each tenant's year range."""
    return holidays_for_years(tenant_years(frame, date_col))


def holiday_date_features(frame: DataFrame, date_col: str = "date") -> DataFrame:
    """F05 per (tenant, date): is_holiday, days_to/since holiday, ramadan / eid windows.

    Distances: each holiday emits the 0..90 dates before (after) it with their
    offsets; the minimum offset per date is the distance, 30 when none.
    Windows: each holiday with pre_days > 0 emits the dates in
    ``[h - pre_days, h)``; overlapping Eid windows union naturally.
    """
    h = holiday_calendar(frame, date_col).select(ORG, "holiday_date", "category", "pre_days").distinct()
    dates = frame.select(ORG, F.col(date_col).alias("date")).distinct()
    offs = F.sequence(F.lit(0), F.lit(LOOKAHEAD_DAYS))
    to_next = (h.select(ORG, "holiday_date", F.explode(offs).alias("k"))
                .select(ORG, F.date_sub("holiday_date", F.col("k")).alias("date"), "k")
                .groupBy(ORG, "date").agg(F.min("k").alias("days_to_holiday")))
    since = (h.select(ORG, "holiday_date", F.explode(offs).alias("k"))
              .select(ORG, F.date_add("holiday_date", F.col("k")).alias("date"), "k")
              .groupBy(ORG, "date").agg(F.min("k").alias("days_since_holiday")))
    win = (h.filter(F.col("pre_days") > 0)
            .select(ORG, "holiday_date", "category",
                    F.explode(F.sequence(F.lit(1), F.col("pre_days"))).alias("k"))
            .select(ORG, F.date_sub("holiday_date", F.col("k")).alias("date"), "category")
            .groupBy(ORG, "date")
            .agg(F.max((F.col("category") == "ramadan").cast("int")).alias("in_ramadan_window"),
                 F.max((F.col("category") == "eid").cast("int")).alias("in_eid_window")))
    out = (dates.join(to_next, [ORG, "date"], "left")
                .join(since, [ORG, "date"], "left")
                .join(win, [ORG, "date"], "left"))
    return out.select(
        ORG, "date",
        (F.col("days_to_holiday") == 0).cast("int").alias("is_holiday"),
        F.coalesce("days_to_holiday", F.lit(NO_HOLIDAY_DISTANCE)).alias("days_to_holiday"),
        F.coalesce("days_since_holiday", F.lit(NO_HOLIDAY_DISTANCE)).alias("days_since_holiday"),
        F.coalesce("in_ramadan_window", F.lit(0)).alias("in_ramadan_window"),
        F.coalesce("in_eid_window", F.lit(0)).alias("in_eid_window"),
    ).withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))


def add_holiday_features(frame: DataFrame, date_col: str = "date", dates_from: DataFrame | None = None) -> DataFrame:
    """Join the per-date holiday features onto any dated frame.

    ``dates_from`` (a narrow frame with the same tenant dates, e.g. the stored
    fact) keeps the small date-dimension branch off the wide input's lineage.
    """
    from tillsight.sources.tables import materialize
    # The per-date dimension is bounded by tenants × calendar days; storing it
    # gives the planner its real (small) size, so it is broadcast into the big
    # frame instead of shuffling the big frame to meet it.
    feats = materialize(holiday_date_features(dates_from if dates_from is not None else frame, date_col),
                        "holiday-dates")
    if date_col != "date":
        feats = feats.withColumnRenamed("date", date_col)
    return frame.join(feats, [ORG, date_col], "left")


def holiday_names(frame: DataFrame, date_col: str = "date") -> DataFrame:
    """holiday name of each date (NULL when none), same year's calendar."""
    cal = holiday_calendar(frame, date_col).select(
        ORG, F.col("holiday_date").alias(date_col), F.col("name").alias("holiday_name"), "table_year")
    cal = cal.filter(F.year(date_col) == F.col("table_year")).drop("table_year")
    return frame.join(cal, [ORG, date_col], "left")


def holidays_in_range(frame: DataFrame, start, end) -> DataFrame:
    """each tenant's holidays between two dates (inclusive), over the years they
    span; the dates may be columns of a frame with one row per tenant."""
    spans = frame.select(ORG, as_date(start).alias("_lo"), as_date(end).alias("_hi")).distinct()
    years = spans.select(ORG, F.explode(F.sequence(F.year("_lo"), F.year("_hi"))).alias("year")).distinct()
    h = holidays_for_years(years).join(per_tenant(spans), ORG)
    return h.filter(F.col("holiday_date").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def _dates_with_next_year(dates: DataFrame) -> DataFrame:
    years = dates.select(ORG, F.explode(F.array(F.year("as_of"), F.year("as_of") + 1)).alias("year")).distinct()
    return holidays_for_years(years)


def pre_holiday_window(dates: DataFrame) -> DataFrame:
    """for each (tenant, as_of) the first holiday whose pre-window contains it.

    Holidays of the date's year and the next are exploded to their window
    days, equi-joined on the date and ranked by holiday date.
    """
    h = _dates_with_next_year(dates).filter(F.col("pre_days") > 0)
    days = (h.select(ORG, "table_year", "name", "holiday_date", "pre_days", "demand_multiplier", "advice",
                     "category",
                     F.explode(F.sequence(F.lit(1), F.col("pre_days"))).alias("days_until_holiday"))
             .withColumn("as_of", F.date_sub("holiday_date", F.col("days_until_holiday"))))
    j = dates.join(days, [ORG, "as_of"]).filter(
        F.col("table_year").isin(F.year("as_of"), F.year("as_of") + 1))
    w = Window.partitionBy(ORG, "as_of").orderBy("holiday_date", "table_year", "name")
    return (j.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
             .select(ORG, "as_of", F.col("name").alias("holiday_name"), "holiday_date",
                     F.col("days_until_holiday").cast("bigint").alias("days_until_holiday"),
                     F.col("pre_days").cast("bigint").alias("pre_window_days"),
                     "demand_multiplier", "advice", "category"))


def upcoming_holidays(as_of_df: DataFrame, limit: int = 5) -> DataFrame:
    """next ``limit`` holidays on or after each tenant's as_of (this and next year)."""
    h = _dates_with_next_year(as_of_df)
    j = (as_of_df.join(h, ORG).filter(F.col("holiday_date") >= F.col("as_of"))
                 .withColumn("days_until", F.datediff("holiday_date", "as_of").cast("bigint")))
    w = Window.partitionBy(ORG, "as_of").orderBy("holiday_date", "table_year", "name")
    return (j.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit)
             .select(ORG, "as_of", "rank", "name", "holiday_date", "days_until", "category",
                     "demand_multiplier", "advice"))


def season_weather(frame: DataFrame, date_col: str = "date", weather: DataFrame | None = None) -> DataFrame:
    """Weather columns per row — joined from a daily weather table when
    given (left join on the calendar date), else the season defaults."""
    if weather is not None:
        w = weather.withColumn("_wdate", F.to_date("date")).drop("date")
        return (frame.withColumn("_wdate", F.to_date(date_col))
                     .join(w, "_wdate", "left").drop("_wdate"))
    s = C.season(date_col)
    return (frame.withColumn("season", s)
                 .withColumn("temp_c", C.season_lookup("season", 0, 25).cast("double"))
                 .withColumn("humidity_pct", C.season_lookup("season", 1, 50).cast("double"))
                 .withColumn("rain_mm", C.season_lookup("season", 2, 5).cast("double")))


def demand_multiplier(as_of_df: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """season × pre-holiday × weather multiplier (2 dp) with its reasons, per tenant as_of.

    Current temperature is the season default (F12b) unless a weather table is
    given.
    """
    pre = pre_holiday_window(as_of_df)
    b = as_of_df.join(pre.select(ORG, "as_of", "holiday_name", F.col("demand_multiplier").alias("_hm")),
                      [ORG, "as_of"], "left")
    b = b.withColumn("season", C.season("as_of"))
    if weather is None:
        b = b.withColumn("temp_c", C.season_lookup("season", 0, 25).cast("double"))
    else:
        b = b.join(weather.select(F.to_date("date").alias("as_of"), "temp_c"), "as_of", "left")
    sm = C.season_multiplier("season")
    season_f = F.when(sm > 1.0, sm).otherwise(F.lit(1.0))
    hol_f = F.coalesce("_hm", F.lit(1.0))
    t = F.col("temp_c")
    wx_f = F.when(t >= 35, 1.2).when(t <= 10, 1.15).otherwise(1.0)
    reasons = F.filter(F.array(
        F.when(sm > 1.0, F.format_string("%s season (%sx)", F.col("season"), sm.cast("string"))),
        F.when(F.col("holiday_name").isNotNull(),
               F.format_string("Pre-%s window (%sx)", F.col("holiday_name"), hol_f.cast("string"))),
        F.when(t >= 35, F.format_string("Extreme heat (%.0f°C - 1.2x)", t))
         .when(t <= 10, F.format_string("Cold wave (%.0f°C - 1.15x)", t)),
    ), lambda x: x.isNotNull())
    return b.select(ORG, "as_of", "season",
                    F.round(season_f * hol_f * wx_f, 2).alias("multiplier"),
                    reasons.alias("reasons"),
                    F.col("holiday_name").isNotNull().alias("has_pre_holiday"),
                    "holiday_name")


def holiday_stock_advice(as_of_df: DataFrame, limit: int = 10) -> DataFrame:
    """stock-up advice for the next ``limit`` holidays that have advice."""
    up = upcoming_holidays(as_of_df, limit).filter(F.col("advice") != "")
    d = F.col("days_until")
    return up.select(ORG, "as_of", F.lit("holiday_stock_up").alias("type"), F.col("name").alias("holiday"),
                     F.col("holiday_date").alias("date"), "days_until",
                     F.when(d <= 14, "high").when(d <= 30, "medium").otherwise("low").alias("priority"),
                     F.col("advice").alias("suggestion"), "demand_multiplier")


def daily_weather(three_hourly: DataFrame) -> DataFrame:
    """3-hourly weather -> daily means / min / max / sum and the modal condition.

    ``mode(..., deterministic=True)`` picks the smallest value on ties, as the
    pandas mode's first element does.
    """
    d = three_hourly.withColumn("date", F.to_date("datetime"))
    return (d.groupBy("date").agg(
        F.avg("temperature_c").alias("temp_c"), F.avg("feels_like_c").alias("feels_like_c"),
        F.min("temp_min_c").alias("temp_min_c"), F.max("temp_max_c").alias("temp_max_c"),
        F.avg("humidity_pct").alias("humidity_pct"), F.avg("pressure_hpa").alias("pressure_hpa"),
        F.max("wind_speed_ms").alias("wind_speed_ms"), F.sum("rain_3h_mm").alias("rain_mm"),
        F.coalesce(F.mode("weather_condition", True), F.lit("Unknown")).alias("weather_condition"),
        F.coalesce(F.mode("weather_description", True), F.lit("")).alias("weather_description"))
        .withColumn("season", C.season("date")))


def _defaults_cols(season_col: str = "season") -> list:
    t = C.season_lookup(season_col, 0, 25).cast("double")
    return [
        t.alias("temp_c"), t.alias("feels_like_c"), (t - 3).alias("temp_min_c"), (t + 3).alias("temp_max_c"),
        C.season_lookup(season_col, 1, 50).cast("double").alias("humidity_pct"),
        F.lit(1013.0).alias("pressure_hpa"), F.lit(5.0).alias("wind_speed_ms"),
        C.season_lookup(season_col, 3, "Clear").alias("weather_condition"),
        F.concat(F.col(season_col), F.lit(" conditions")).alias("weather_description"),
    ]


def fallback_forecast(as_of_df: DataFrame, days: int = 7) -> DataFrame:
    """placeholder daily weather for ``days`` days from as_of, from season defaults."""
    d = (as_of_df.select(ORG, "as_of", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("k"))
                 .withColumn("date", F.date_add("as_of", F.col("k")))
                 .withColumn("season", C.season("date")))
    return d.select(ORG, "date", *_defaults_cols(),
                    F.when(F.col("season") == "Monsoon", 15.0).otherwise(0.0).alias("rain_mm"), "season")


def fallback_current(as_of_df: DataFrame) -> DataFrame:
    """Season-default current weather at as_of."""
    d = as_of_df.withColumn("season", C.season("as_of"))
    return d.select(ORG, "as_of", *_defaults_cols(), "season")


def seasonal_demand_advice(as_of_df: DataFrame) -> DataFrame:
    """season advice and keyword lists at as_of."""
    s = as_of_df.withColumn("season", C.season("as_of"))
    return s.select(ORG, "as_of", "season", C.seasonal_advice("season").alias("advice"),
                    C.seasonal_keywords("season", 0).alias("high_demand"),
                    C.seasonal_keywords("season", 1).alias("low_demand"))


def keyword_table(spark: SparkSession) -> DataFrame:
    """(season, kind, ord, keyword): the fixed seasonal keyword lists as rows."""
    def build():
        rows = []
        for s, (hi, lo, _) in C.SEASONAL_PRODUCT_DEMAND.items():
            rows += [(s, "high_demand", 0, i, k) for i, k in enumerate(hi)]
            rows += [(s, "low_demand", 1, i, k) for i, k in enumerate(lo)]
        return spark.createDataFrame(rows, "season string, alert string, kind int, ord int, keyword string")
    return _constant(spark, "keywords", build)


def seasonal_product_alerts(products: DataFrame, as_of_df: DataFrame) -> DataFrame:
    """Per product, the first seasonal keyword contained in its name
    (high list first, then low) at the tenant's as_of season; else ``normal``.

    The keyword side is a fixed table of about 100 rows, broadcast; the join
    condition is a substring test, so it runs as a broadcast nested-loop join
    whose cost is products × keywords, linear in the products.
    """
    spark = products.sparkSession
    p = products.join(per_tenant(as_of_df.select(ORG, "as_of")), ORG).withColumn("season", C.season("as_of"))
    kw = F.broadcast(keyword_table(spark))
    m = p.join(kw, (p.season == kw.season) & F.lower(p.name).contains(kw.keyword), "left").drop(kw.season)
    w = Window.partitionBy(ORG, "item_id").orderBy(F.col("kind").asc_nulls_last(), F.col("ord").asc_nulls_last())
    first = m.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    alert = F.coalesce("alert", F.lit("normal"))
    msg = (F.when(F.col("alert") == "high_demand",
                  F.format_string("⚠️ **%s** is in high demand during %s. Increase stock.", "name", "season"))
            .when(F.col("alert") == "low_demand",
                  F.format_string("ℹ️ **%s** has lower demand during %s. Reduce stock.", "name", "season"))
            .otherwise(""))
    action = (F.when(F.col("alert") == "high_demand", "Increase stock")
               .when(F.col("alert") == "low_demand", "Reduce stock").otherwise(""))
    return first.select(ORG, "item_id", "name", "season", alert.alias("alert"), "keyword",
                        msg.alias("message"), action.alias("action"))


def date_context(as_of_df: DataFrame) -> DataFrame:
    """one context record per tenant: holiday today, season, default weather,
    pre-holiday window, multiplier and the next three holidays."""
    names = holiday_names(as_of_df.withColumnRenamed("as_of", "date"))
    names = names.select(ORG, F.col("date").alias("as_of"), "holiday_name")
    mult = demand_multiplier(as_of_df).select(ORG, "as_of", "season", "multiplier",
                                              F.col("holiday_name").alias("pre_holiday_name"))
    wx = fallback_current(as_of_df).select(ORG, "as_of", "temp_c", "humidity_pct", "weather_condition")
    up = upcoming_holidays(as_of_df, 3)
    nxt = (up.groupBy(ORG, "as_of")
             .agg(F.sort_array(F.collect_list(F.struct("rank", "name", "holiday_date", "days_until")))
                  .alias("next_holidays")))
    return (as_of_df.join(names, [ORG, "as_of"], "left").join(mult, [ORG, "as_of"], "left")
                    .join(wx, [ORG, "as_of"], "left").join(nxt, [ORG, "as_of"], "left")
                    .withColumn("is_holiday", F.col("holiday_name").isNotNull()))
