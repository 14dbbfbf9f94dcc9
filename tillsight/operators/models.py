"""Demand models, forecasts and accuracy metrics.

* Metrics (G10-G12) are one ``groupBy(...).agg`` — no per-group Python.
* Tree models (G02-G04) of all tenants are grown in one job (``operators/trees.py``,
  with their importances and attributions G15 / G16 and the recursive
  forecast); linear and additive models (G05, G16) come from mergeable cross
  sums (``operators/linear.py``).
* Multi-step forecasts (G13) need no recursion in the reference's default
  mode (only calendar parts change), so they are one ``explode`` of the
  horizon on each series' last row followed by one scoring pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import calendar as C
from tillsight.functions.core import ORG, checked_broadcast, col, per_tenant
from tillsight.operators import trees
from tillsight.operators.features import SERIES
from tillsight.operators.linear import additive_forecast  # noqa: F401 — G05 is offered next to the other models
from tillsight.sources.tables import materialize


# ------------------------------------------------------------------- metrics

METRICS = ("points", "mae", "rmse", "r2", "mape", "wape", "bias", "bias_percent")


def metric_columns(actual: str | Column = "actual", pred: str | Column = "pred") -> list[Column]:
    """G10/G11 as aggregate expressions over rows where both values are present."""
    actual, pred = col(actual), col(pred)
    ok = actual.isNotNull() & pred.isNotNull() & ~F.isnan(actual) & ~F.isnan(pred)
    a = F.when(ok, actual.cast("double"))
    p = F.when(ok, pred.cast("double"))
    err = p - a
    n = F.count(a)
    sse = F.sum(err * err)
    sst = F.var_pop(a) * n
    mean_a = F.avg(a)
    return [
        n.alias("points"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(sst > 0, 1 - sse / sst).alias("r2"),
        (F.avg(F.when(a != 0, F.abs(err / a))) * 100).alias("mape"),
        F.when(F.sum(F.abs(a)) > 0, F.sum(F.abs(err)) / F.sum(F.abs(a)) * 100).alias("wape"),
        F.avg(err).alias("bias"),
        F.when(mean_a != 0, F.avg(err) / mean_a * 100).alias("bias_percent"),
    ]


def metrics(df: DataFrame, keys: list[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """MAE, RMSE, R², MAPE (actual ≠ 0), WAPE, bias, bias % per key."""
    return df.groupBy(*keys).agg(*metric_columns(actual, pred))


def evaluate_forecast(forecast: DataFrame, actuals: DataFrame, grain: list[str] | None = None,
                      pred_col: str = "predicted_sales", actual_col: str = "sales") -> DataFrame:
    """Forecast ⋈ actuals on (tenant, date, grain), actuals de-duplicated
    on that key first, then metrics per grain. With no grain the overall totals
    are evaluated: forecasts and actuals are summed per (tenant, date) first."""
    if not grain:
        fc = forecast.groupBy(ORG, "date").agg(F.sum(pred_col).alias(pred_col))
        act = actuals.groupBy(ORG, "date").agg(F.sum(actual_col).alias(actual_col))
        return metrics(fc.join(act, [ORG, "date"]), [ORG], actual_col, pred_col)
    key = [ORG, "date"] + list(grain)
    act = actuals.select(*key, actual_col).dropDuplicates(key)
    j = forecast.select(*key, pred_col).join(act, key)
    return metrics(j, [ORG] + list(grain), actual_col, pred_col)


# ------------------------------------------------------------------- splits

def in_test(keys: list[str], test_pct: int = 20, seed: int = 42) -> Column:
    """Whether a hash of the row key puts a row into the test set (no shuffle, no RNG state)."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(100)) < test_pct


def hash_split(df: DataFrame, keys: list[str], test_pct: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable row split by a hash of the row key."""
    test = in_test(keys, test_pct, seed)
    return df.filter(~test), df.filter(test)


def holdout_split(df: DataFrame, days: int = 28, date_col: str = "date") -> tuple[DataFrame, DataFrame]:
    """Last ``days`` calendar days of each tenant are the test set."""
    cut = df.groupBy(ORG).agg(F.max(date_col).alias("_max"))
    j = df.join(per_tenant(cut), ORG)
    test = F.col(date_col) > F.date_sub("_max", days)
    return j.filter(~test).drop("_max"), j.filter(test).drop("_max")


# ------------------------------------------------------------------ baseline

def baseline_fit(train: DataFrame, target: str = "sales") -> DataFrame:
    """Per-series mean and the tenant's unweighted mean of series means."""
    s = train.groupBy(*SERIES).agg(F.avg(target).alias("series_mean"))
    g = s.groupBy(ORG).agg(F.avg("series_mean").alias("global_mean"))
    return s.join(g, ORG)


def baseline_predict(model: DataFrame, rows: DataFrame, per_series: bool = False) -> DataFrame:
    """G01 prediction: the tenant constant (reference) or the series mean (``per_series``)."""
    if per_series:
        m = model.select(*SERIES, "series_mean", "global_mean")
        j = rows.join(m, SERIES, "left").join(per_tenant(model.select(ORG, "global_mean").distinct()
                                                          .withColumnRenamed("global_mean", "_g")), ORG, "left")
        return j.withColumn("pred", F.coalesce("series_mean", "_g")).drop("series_mean", "global_mean", "_g")
    g = model.select(ORG, "global_mean").distinct()
    return rows.join(per_tenant(g), ORG, "left").withColumnRenamed("global_mean", "pred")


# --------------------------------------------------------------- tree models

def fitted(frame: DataFrame, models=tuple(trees.SPECS), target: str = "sales", specs: dict | None = None, test_pct: int = 20,
           fit_rows: int = trees.FIT_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """(models of every tenant, the sampled rows with ``_test``, feature columns).

    At most ``fit_rows`` rows of each tenant take part (the reference's bound); of these,
    ``test_pct`` in a hundred, by key hash, are held out. Rows and models are stored: scoring, metrics and
    attribution read them again.
    """
    keys = SERIES + ["date"]
    features = trees.numeric_features(frame, target)
    narrow = frame.where(F.col(target).isNotNull()).select(*keys, target, *features)
    rows = materialize(trees.fit_sample(narrow, keys, fit_rows).withColumn("_test", in_test(keys, test_pct)), "model-rows")
    packed = materialize(trees.pack(rows.where(~F.col("_test")), features, keys, target, fit_rows=fit_rows), "model-codes")
    return materialize(trees.fit_models(packed, models, specs), "models"), rows, features


def compare_models(frame: DataFrame, models=("baseline", *trees.SPECS), target: str = "sales", specs: dict | None = None, test_pct: int = 20) -> DataFrame:
    """Per tenant, every model's metrics on the held-out rows (``train_*``: on the rows it was fitted on) and
    its fitting seconds; ``is_best`` marks the tenant's lowest MAE. A model without rows to fit keeps a NULL row
    with its ``error``. The baseline is fitted on all rows, as in the reference (it scores rows it has seen)."""
    grown = [m for m in models if m != "baseline"]
    fits, rows, features = fitted(frame, grown, target, specs, test_pct)
    keys = SERIES + ["date"]
    scored = trees.score(rows, fits, features, keys, [target, "_test"]) if grown else None
    if "baseline" in models:
        base = baseline_predict(baseline_fit(rows, target), rows).select(*keys, target, "_test", F.lit("baseline").alias("model"), "pred")
        scored = base if scored is None else scored.unionByName(base)
    each = scored.groupBy(ORG, "model").agg(
        *metric_columns(F.when(F.col("_test"), F.col(target)), "pred"),
        *[c.alias(f"train_{n}") for c, n in zip(metric_columns(F.when(~F.col("_test"), F.col(target)), "pred"), METRICS) if n in ("mae", "rmse", "r2")])
    names = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    grid = frame.select(ORG).distinct().select(ORG, names)  # one row per tenant and model
    seconds = fits.groupBy(ORG, "model").agg(F.sum("seconds").alias("training_time_sec"))
    out = grid.join(each, [ORG, "model"], "left").join(seconds, [ORG, "model"], "left")
    out = out.withColumn("error", F.when(F.col("mae").isNull(), F.lit("no rows to fit and score")))
    best = F.min_by("model", F.when(F.col("mae").isNotNull(), F.struct("mae", "model"))).over(Window.partitionBy(ORG))  # a row per model
    return out.withColumn("is_best", F.coalesce(F.col("model") == best, F.lit(False)))


# ------------------------------------------------------------- forecasting

CALENDAR_PARTS = {
    "year": lambda d: F.year(d), "month": lambda d: F.month(d), "day": lambda d: F.dayofmonth(d),
    "dayofweek": lambda d: C.weekday0(d), "quarter": lambda d: F.quarter(d),
    "is_weekend": lambda d: (C.weekday0(d) >= 5).cast("int"),
}


def future_frame(features: DataFrame, horizon: int = 28) -> DataFrame:
    """Each series' last feature row repeated for the ``horizon`` days after its
    tenant's last date, with only year / month / day / dayofweek / quarter /
    is_weekend recomputed (the reference's default: lags are not refreshed)."""
    latest = features.groupBy(*SERIES).agg(F.max("date").alias("date"))  # a series has one row per day
    last = features.join(checked_broadcast(latest), SERIES + ["date"])   # up to its bound, wide rows stay where they are
    origin = features.groupBy(ORG).agg(F.max("date").alias("_origin"))
    fut = last.join(per_tenant(origin), ORG).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))) \
              .withColumn("date", F.date_add("_origin", F.col("_k"))).drop("_k", "_origin")
    return fut.withColumns({c: fn(F.col("date")) for c, fn in CALENDAR_PARTS.items() if c in fut.columns})


def forecast_series(models: DataFrame, frame: DataFrame, features: list[str], horizon: int = 28) -> DataFrame:
    """Forecast every series ``horizon`` days ahead by each model of its tenant
    (``trees.forecast_recursive`` is the mode that feeds predictions back)."""
    scored = trees.score(future_frame(frame, horizon), models, features, SERIES + ["date"])
    return scored.withColumnRenamed("pred", "predicted_sales")


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Total, mean, peak day and peak value per series."""
    return forecast.groupBy(*SERIES).agg(
        F.sum("predicted_sales").alias("total_forecast"), F.avg("predicted_sales").alias("avg_daily_forecast"),
        F.min_by("date", F.struct(-F.col("predicted_sales"), F.col("date"))).alias("peak_date"),
        F.max("predicted_sales").alias("peak_value"), F.count(F.lit(1)).alias("horizon_days"))


def baseline_forecast(fact: DataFrame, horizon: int = 28, as_of=None, per_series: bool = True) -> DataFrame:
    """A fully SQL-expressible forecast: every series' mean sales up to ``as_of``
    (tenant latest date minus the horizon when None), for each of the next
    ``horizon`` days."""
    cut = fact.groupBy(ORG).agg(F.max("date").alias("_max"))
    f = fact.join(per_tenant(cut), ORG)
    cutoff = F.date_sub("_max", horizon) if as_of is None else F.to_date(F.lit(as_of))
    train = f.filter(F.col("date") <= cutoff)
    model = baseline_fit(train)
    origin = train.groupBy(ORG).agg(F.max("date").alias("origin"))
    series = model.join(per_tenant(origin), ORG)
    fc = series.select(*SERIES, "origin", "series_mean", "global_mean",
                       F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    pred = F.col("series_mean") if per_series else F.col("global_mean")
    return fc.select(*SERIES, "origin", F.date_add("origin", F.col("h")).alias("date"),
                     pred.alias("predicted_sales"))


# ------------------------------------------------------------ error tables

def error_tables(scored: DataFrame, by: str, actual: str = "sales", pred: str = "pred") -> DataFrame:
    """By store / category: actual and predicted sums, mean abs error, MAPE of sums."""
    return scored.groupBy(ORG, by).agg(
        F.sum(actual).alias("actual_sum"), F.sum(pred).alias("predicted_sum"),
        F.avg(F.abs(F.col(actual) - F.col(pred))).alias("mae")
    ).withColumn("mape_of_sums", F.when(F.col("actual_sum") != 0, F.abs(F.col("actual_sum") - F.col("predicted_sum"))
                                        / F.col("actual_sum") * 100))


def worst_rows(scored: DataFrame, k: int = 20, actual: str = "sales", pred: str = "pred") -> DataFrame:
    """The k rows with the largest absolute error per tenant."""
    w = Window.partitionBy(ORG).orderBy(F.desc(F.abs(F.col(actual) - F.col(pred))), "item_id", "store_id", "date")
    return (scored.withColumn("abs_error", F.abs(F.col(actual) - F.col(pred)))
                  .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
