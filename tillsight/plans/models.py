"""Registered model, forecast and accuracy queries (G01-G25) with DuckDB oracles.

The SQL-checkable forecast is the per-series mean baseline: each series' mean
sales up to 28 days before the tenant's last date, predicted for each of the
28 days after. Model fits (random forest, boosted trees, additive model) are
registered rows-only; tests check splits, sums, attributions and forecasts by brute force.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillsight.functions.core import ORG
from tillsight.operators import features as E
from tillsight.operators import linear as L
from tillsight.operators import models as G
from tillsight.operators import registry as R
from tillsight.operators import trees
from tillsight.plans.catalog import query, r4, with_fact
from tillsight.sources.tables import materialize, sales_fact

HORIZON = 28

BASE_SQL = f"""
mx AS (SELECT organization_id, MAX(date) AS mx FROM fact GROUP BY 1),
tr AS (SELECT f.* FROM fact f JOIN mx USING (organization_id) WHERE f.date <= mx.mx - INTERVAL {HORIZON} DAY),
sm AS (SELECT organization_id, item_id, store_id, AVG(sales) AS series_mean FROM tr GROUP BY 1, 2, 3),
gm AS (SELECT organization_id, AVG(series_mean) AS global_mean FROM sm GROUP BY 1),
org AS (SELECT organization_id, MAX(date) AS origin FROM tr GROUP BY 1),
fc AS (SELECT sm.organization_id, sm.item_id, sm.store_id, org.origin,
              CAST(org.origin + to_days(CAST(h AS INTEGER)) AS DATE) AS date, sm.series_mean AS predicted_sales
       FROM sm JOIN org USING (organization_id), range(1, {HORIZON + 1}) t(h)),
j AS (SELECT fc.*, f.sales FROM fc JOIN fact f USING (organization_id, item_id, store_id, date))"""

METRICS_SQL = """COUNT(*) AS points, {mae}, {rmse},
  {r2}, {mape}, {wape}, {bias}, {biasp}""".format(
    mae=r4("AVG(abs(predicted_sales - sales))", "mae"),
    rmse=r4("sqrt(AVG((predicted_sales - sales) * (predicted_sales - sales)))", "rmse"),
    r2=r4("CASE WHEN var_pop(sales) * COUNT(*) > 0 THEN 1 - SUM((predicted_sales - sales) * (predicted_sales - sales))"
          " / (var_pop(sales) * COUNT(*)) END", "r2"),
    mape=r4("AVG(CASE WHEN sales <> 0 THEN abs((predicted_sales - sales) / sales) END) * 100", "mape"),
    wape=r4("CASE WHEN SUM(abs(sales)) > 0 THEN SUM(abs(predicted_sales - sales)) / SUM(abs(sales)) * 100 END",
            "wape"),
    bias=r4("AVG(predicted_sales - sales)", "bias"),
    biasp=r4("CASE WHEN AVG(sales) <> 0 THEN AVG(predicted_sales - sales) / AVG(sales) * 100 END", "bias_percent"))


def _baseline_fc(spark, sf):
    fact = sales_fact(spark, sf)
    return fact, G.baseline_forecast(fact, HORIZON)


@query("g01_baseline_model", with_fact(f"""WITH {BASE_SQL}
SELECT organization_id, item_id, store_id, {r4('series_mean', 'series_mean')}, {r4('global_mean', 'global_mean')}
FROM sm JOIN gm USING (organization_id)"""))
def g01(spark, sf):
    """Baseline model: series means before the 28-day holdout and the tenant's mean of means."""
    fact = sales_fact(spark, sf)
    train, _ = G.holdout_split(fact, HORIZON)
    return G.baseline_fit(train)


@query("g10_baseline_holdout_metrics", with_fact(f"""WITH {BASE_SQL},
hold AS (SELECT f.organization_id, f.sales, gm.global_mean AS predicted_sales
         FROM fact f JOIN mx USING (organization_id) JOIN gm USING (organization_id)
         WHERE f.date > mx.mx - INTERVAL {HORIZON} DAY)
SELECT organization_id, {METRICS_SQL} FROM hold GROUP BY 1"""))
def g10(spark, sf):
    """MAE / RMSE / R² / MAPE / WAPE / bias of the constant baseline on the last 28 days."""
    fact = sales_fact(spark, sf)
    train, test = G.holdout_split(fact, HORIZON)
    scored = G.baseline_predict(G.baseline_fit(train), test)
    return G.metrics(scored, [ORG], "sales", "pred")


@query("g12_forecast_eval_overall", with_fact(f"""WITH {BASE_SQL},
tf AS (SELECT organization_id, date, SUM(predicted_sales) AS predicted_sales FROM fc GROUP BY 1, 2),
ta AS (SELECT organization_id, date, SUM(sales) AS sales FROM fact GROUP BY 1, 2),
tj AS (SELECT * FROM tf JOIN ta USING (organization_id, date))
SELECT organization_id, {METRICS_SQL} FROM tj GROUP BY 1"""))
def g12(spark, sf):
    """Per-series-mean forecast vs actuals at the tenant's daily-total level."""
    fact, fc = _baseline_fc(spark, sf)
    return G.evaluate_forecast(fc, fact)


@query("g12_forecast_eval_series", with_fact(f"""WITH {BASE_SQL}
SELECT organization_id, item_id, store_id, {METRICS_SQL} FROM j GROUP BY 1, 2, 3"""))
def g12s(spark, sf):
    """Per-series-mean forecast vs actuals per series."""
    fact, fc = _baseline_fc(spark, sf)
    return G.evaluate_forecast(fc, fact, ["item_id", "store_id"])


@query("g14_forecast_summary", with_fact(f"""WITH {BASE_SQL}
SELECT organization_id, item_id, store_id, {r4('SUM(predicted_sales)', 'total_forecast')},
       {r4('AVG(predicted_sales)', 'avg_daily_forecast')}, MIN(date) AS peak_date,
       {r4('MAX(predicted_sales)', 'peak_value')}, COUNT(*) AS horizon_days
FROM fc GROUP BY 1, 2, 3"""))
def g14(spark, sf):
    """Forecast total, mean, peak day and value per series (baseline forecast)."""
    _, fc = _baseline_fc(spark, sf)
    return G.forecast_summary(fc)


@query("g17_error_by_store", with_fact(f"""WITH {BASE_SQL}
SELECT organization_id, store_id, {r4('SUM(sales)', 'actual_sum')}, {r4('SUM(predicted_sales)', 'predicted_sum')},
       {r4('AVG(abs(sales - predicted_sales))', 'mae')},
       {r4('CASE WHEN SUM(sales) <> 0 THEN abs(SUM(sales) - SUM(predicted_sales)) / SUM(sales) * 100 END', 'mape_of_sums')}
FROM j GROUP BY 1, 2"""))
def g17(spark, sf):
    """Forecast error table by store."""
    fact, fc = _baseline_fc(spark, sf)
    j = fc.join(fact.select(ORG, "item_id", "store_id", "date", "sales"), [ORG, "item_id", "store_id", "date"])
    return G.error_tables(j, "store_id", "sales", "predicted_sales")


@query("g17_worst_rows", with_fact(f"""WITH {BASE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY organization_id
        ORDER BY abs(sales - predicted_sales) DESC, item_id, store_id, date) AS rank FROM j)
SELECT organization_id, item_id, store_id, date, {r4('sales', 'sales')}, {r4('predicted_sales', 'predicted_sales')},
       {r4('abs(sales - predicted_sales)', 'abs_error')}, CAST(rank AS BIGINT) AS rank
FROM r WHERE rank <= 20"""))
def g17w(spark, sf):
    """The 20 largest forecast errors per tenant."""
    fact, fc = _baseline_fc(spark, sf)
    j = fc.join(fact.select(ORG, "item_id", "store_id", "date", "sales"), [ORG, "item_id", "store_id", "date"])
    return G.worst_rows(j, 20, "sales", "predicted_sales").select(
        ORG, "item_id", "store_id", "date", "sales", "predicted_sales", "abs_error", "rank")


def _matured(spark, sf):
    fact, fc = _baseline_fc(spark, sf)
    hdr, det = R.forecast_tables(fc, "baseline", "2001-01-01 00:00:00")
    return fact, hdr, det


@query("g20_matured_accuracy", with_fact(f"""WITH {BASE_SQL},
hz AS (SELECT organization_id, COUNT(DISTINCT date) AS horizon_days FROM fc GROUP BY 1)
SELECT organization_id, horizon_days, item_id AS product_id, store_id,
       {METRICS_SQL.replace('COUNT(*) AS points', 'COUNT(*) AS eval_points')}
FROM j JOIN hz USING (organization_id) GROUP BY 1, 2, 3, 4"""))
def g20(spark, sf):
    """Matured forecasts vs actuals per tenant, horizon, item and store."""
    fact, hdr, det = _matured(spark, sf)
    return R.matured_accuracy(hdr, det, fact)


@query("g20_live_metrics", with_fact(f"""WITH {BASE_SQL}
SELECT organization_id, {r4('AVG(abs(predicted_sales - sales))', 'live_mae')},
  {r4('CASE WHEN SUM(abs(sales)) > 0 THEN SUM(abs(predicted_sales - sales)) / SUM(abs(sales)) * 100 END', 'live_wape')},
  {r4('AVG(predicted_sales - sales)', 'live_bias')}, COUNT(*) AS live_points
FROM j GROUP BY 1"""))
def g20l(spark, sf):
    """Live accuracy pooled over every matured forecast row per tenant."""
    fact, hdr, det = _matured(spark, sf)
    return R.live_metrics(hdr, det, fact)


@query("g23_accuracy_summary", with_fact(f"""WITH {BASE_SQL},
hz AS (SELECT organization_id, COUNT(DISTINCT date) AS horizon_days FROM fc GROUP BY 1),
acc AS (SELECT organization_id, horizon_days, item_id, store_id, COUNT(*) AS n,
          AVG(abs(predicted_sales - sales)) AS mae,
          sqrt(AVG((predicted_sales - sales) * (predicted_sales - sales))) AS rmse,
          AVG(CASE WHEN sales <> 0 THEN abs((predicted_sales - sales) / sales) END) * 100 AS mape,
          CASE WHEN SUM(abs(sales)) > 0 THEN SUM(abs(predicted_sales - sales)) / SUM(abs(sales)) * 100 END AS wape,
          AVG(predicted_sales - sales) AS bias
        FROM j JOIN hz USING (organization_id) GROUP BY 1, 2, 3, 4)
SELECT organization_id, horizon_days, {r4('AVG(mae)', 'mae')}, {r4('AVG(rmse)', 'rmse')}, {r4('AVG(mape)', 'mape')},
       {r4('AVG(wape)', 'wape')}, {r4('AVG(bias)', 'bias')}, CAST(SUM(n) AS BIGINT) AS eval_points,
       COUNT(*) AS series
FROM acc GROUP BY 1, 2"""))
def g23(spark, sf):
    """Accuracy summary by horizon per tenant."""
    fact, hdr, det = _matured(spark, sf)
    return R.accuracy_summary(R.matured_accuracy(hdr, det, fact))


def _daily(spark, sf):
    return sales_fact(spark, sf).groupBy(ORG, "date").agg(F.sum("sales").alias("sales"))


@query("g05_additive_model")
def g05(spark, sf):
    """Trend with slope changes + yearly + weekly seasons of each tenant's daily totals, with a
    28-day forecast and a 95 % band (rows only; its cross sums have an oracle)."""
    return L.additive_forecast(_daily(spark, sf), HORIZON)


@query("g05_additive_sums", with_fact(f"""WITH day AS (SELECT organization_id, date, SUM(sales) AS y FROM fact GROUP BY 1, 2),
hd AS (SELECT organization_id, MIN(date) AS first, greatest(CAST(date_diff('day', MIN(date), MAX(date)) AS DOUBLE), 1) AS span, MAX(abs(y)) AS scale FROM day GROUP BY 1),
t AS (SELECT day.*, scale, date_diff('day', first, date) / span AS t, CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE) AS d FROM day JOIN hd USING (organization_id)),
v AS (SELECT organization_id, list_concat(list_concat(list_concat(list_concat([1.0, t],
        [greatest(t - {L.CHANGE_SHARE} * (i + 1) / {L.CHANGES + 1}, 0.0) FOR i IN range({L.CHANGES})]),
        flatten([[sin(2 * pi() * k * d / 365.25), cos(2 * pi() * k * d / 365.25)] FOR k IN range(1, {L.YEARLY + 1})])),
        flatten([[sin(2 * pi() * k * d / 7.0), cos(2 * pi() * k * d / 7.0)] FOR k IN range(1, {L.WEEKLY + 1})])), [y / scale]) AS v FROM t),
e AS (SELECT organization_id, i, v[i + 1] AS a, unnest(v) AS b, generate_subscripts(v, 1) - 1 AS j
      FROM v, (SELECT unnest(range({L.WIDTH + 1})) AS i))
SELECT organization_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r4('SUM(a * b)', 's')} FROM e GROUP BY ALL"""))
def g05s(spark, sf):
    """The additive model's cross sums: every product of two design columns, summed over a tenant's days."""
    daily = materialize(_daily(spark, sf), "daily")
    sums = L.additive_sums(daily, L.additive_headers(daily))
    return sums.select(ORG, "i", F.posexplode("s").alias("j", "s"))


@query("g05_additive_metrics")
def g05m(spark, sf):
    """Accuracy of the additive model on each tenant's last 28 days (rows only)."""
    return L.additive_metrics(L.additive_forecast(materialize(_daily(spark, sf), "daily"), HORIZON))


def _features(spark, sf):
    """The feature frame, its series' features stored once: sampling, feature selection, scoring and forecasts read it."""
    return E.all_features(sales_fact(spark, sf), stored=True)


def _forest(spark, sf):
    """(feature frame, every tenant's random forest, its sampled rows, feature columns)."""
    frame = _features(spark, sf)
    return frame, *G.fitted(frame, ["random_forest"])


@query("g06_model_comparison")
def g06(spark, sf):
    """Baseline, random forest and two boosted-tree models of every tenant, fitted on 80 % of its (at most 50,000
    sampled) feature rows at the reference's model sizes and compared on the other 20 % (rows only)."""
    return G.compare_models(_features(spark, sf)).drop("training_time_sec")


@query("g13_forecast_random_forest")
def g13(spark, sf):
    """Forecast of every series 28 days ahead by its tenant's random forest (rows only)."""
    frame, fits, _, features = _forest(spark, sf)
    return G.forecast_series(fits, frame, features, HORIZON).drop("model")


@query("g13_forecast_recursive")
def g13r(spark, sf):
    """As g13, with predictions fed back into lags and rolling statistics (rows only; equal to a day-by-day loop in the tests)."""
    frame, fits, _, features = _forest(spark, sf)
    return trees.forecast_recursive(fits, frame, features, HORIZON).drop("model")


@query("g15_feature_importance")
def g15(spark, sf):
    """Top-20 feature importances of each tenant's random forest (rows only)."""
    _, fits, _, _ = _forest(spark, sf)
    w = Window.partitionBy(ORG).orderBy(F.desc("importance"), "feature")
    return trees.importance(fits).withColumn("rank", F.row_number().over(w)).where("rank <= 20").select(ORG, "rank", "feature", "importance")


def _explained(spark, sf):
    """Attributions of each series' last feature row, from which its forecast starts."""
    frame, fits, _, features = _forest(spark, sf)
    w = Window.partitionBy(*G.SERIES).orderBy(F.desc("date"))
    last = frame.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return trees.attributions(fits, last, features, [*G.SERIES, "date"]), features


@query("g16_tree_attribution")
def g16t(spark, sf):
    """Base value, prediction and ten largest attributions of each series' last row by its tenant's random forest
    (rows only; sums equal predictions, values equal subset enumeration in the tests)."""
    attr, features = _explained(spark, sf)
    named = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("feature_values").alias("value"), F.col("attributions").alias("attribution"))
    ordered = F.array_sort(named, lambda a, b: F.when(F.abs(a["attribution"]) > F.abs(b["attribution"]), -1).when(
        F.abs(a["attribution"]) < F.abs(b["attribution"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    rows = attr.select(*G.SERIES, "date", "prediction", "base_value", F.posexplode(F.slice(ordered, 1, 10)).alias("rank", "a"))
    return rows.select(*G.SERIES, "date", "prediction", "base_value", (F.col("rank") + 1).alias("rank"), "a.feature", "a.value", "a.attribution")


@query("g16_tree_attribution_top")
def g16top(spark, sf):
    """Mean |attribution| of each feature over a tenant's series, top 20 (rows only)."""
    attr, features = _explained(spark, sf)
    return trees.ranked_attributions(attr, features, 20).drop("model")


@query("g16_permutation_importance")
def g16p(spark, sf):
    """Growth of each random forest's mean absolute error on held-out rows when a feature's values
    are permuted within the tenant (rows only)."""
    _, fits, rows, features = _forest(spark, sf)
    return trees.permutation_importance(fits, rows.where("_test"), features, [*G.SERIES, "date"]).drop("model")


@query("g16b_dependence")
def g16b(spark, sf):
    """Mean attribution of last week's mean sales by bucket of its value, per tenant (rows only)."""
    attr, features = _explained(spark, sf)
    return trees.attribution_dependence(attr, features, "sales_rolling_mean_7").drop("model")


@query("g16_linear_attribution_top")
def g16(spark, sf):
    """Mean |attribution| per feature of each tenant's linear demand model, top 20 (rows only)."""
    frame = _features(spark, sf)
    features = trees.numeric_features(frame)
    models = materialize(L.demand_models(frame, features), "linear-models")  # one row per tenant
    attr = L.demand_attributions(models, frame, features, [*G.SERIES, "date"])
    return trees.ranked_attributions(attr, features, 20).drop("model")


@query("a17_forecast_headers", with_fact(f"""WITH {BASE_SQL}
SELECT organization_id, {r4('SUM(predicted_sales)', 'total_forecast')}, COUNT(DISTINCT date) AS horizon_days,
       MIN(date) AS start_date, MAX(date) AS end_date,
       organization_id || ':2001-01-01 00:00:00' AS header_id, 'baseline' AS model_type,
       TIMESTAMP '2001-01-01 00:00:00' AS created_at
FROM fc GROUP BY 1"""))
def a17(spark, sf):
    """Forecast header rows (A17) of the per-series baseline forecast."""
    _, hdr, _ = _matured(spark, sf)
    return hdr
