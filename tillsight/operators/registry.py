"""Model registry, forecast persistence and matured-forecast accuracy.

The registry, forecast headers / details and the accuracy table are plain
tables; every transition (register, promote, rollback, flag) is a keyed
DataFrame rewrite of the affected tenant's rows, never a row-by-row update.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.core import ORG, as_date, checked_broadcast, per_tenant
from tillsight.operators.alerts import degradation_flag
from tillsight.operators.models import metric_columns
from tillsight.sources.tables import materialize

REGISTRY_SCHEMA = ("organization_id string, version int, algorithm string, status string, "
                   "mae double, rmse double, mape double, wape double, bias double, r2 double, "
                   "live_mae double, live_wape double, live_bias double, evaluation_rows long, "
                   "features_used string, hyperparameters string, trained_at timestamp, promoted_at timestamp, "
                   "degradation_flagged boolean")
STATUSES = ("active", "candidate", "archived", "failed", "rolled_back")


def register_candidates(comparison: DataFrame, registry: DataFrame | None, tenants: DataFrame,
                        features: list[str], specs: dict, trained_at: str) -> DataFrame:
    """One candidate row per successfully trained model and tenant; versions
    continue after the tenant's highest. Returns only the new rows.

    ``comparison`` holds one row per tenant and model (``organization_id`` among
    its columns). A comparison pooled over tenants (no such column, one row per
    model) gives every tenant of ``tenants`` its rows.
    """
    spark = comparison.sparkSession
    base = (registry.groupBy(ORG).agg(F.max("version").alias("_v")) if registry is not None
            else spark.createDataFrame([], "organization_id string, _v int"))
    ok = comparison.filter(F.col("error").isNull() & F.col("mae").isNotNull())
    hp = F.create_map(*[x for k, v in specs.items() for x in (F.lit(k), F.lit(json.dumps(v, sort_keys=True)))]) if specs \
        else F.create_map(F.lit(""), F.lit(""))
    t = tenants.select(ORG).distinct()
    if ORG in comparison.columns:
        per_model = ok.join(per_tenant(t), ORG, "left_semi")
    else:
        # one array with a struct per model: as many as there are model kinds, whatever the data
        models = ok.groupBy().agg(F.collect_list(F.struct(*ok.columns)).alias("_m"))
        rows = models.first()["_m"]
        per_model = t.select(ORG, F.explode(F.array(*[F.struct(*[F.lit(r[c]).cast(ok.schema[c].dataType).alias(c) for c in ok.columns])
                                                      for r in rows])).alias("_m")).select(ORG, "_m.*") if rows \
            else spark.createDataFrame([], f"{ORG} string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ok.schema))
    j = per_model.join(per_tenant(base), ORG, "left")
    w = Window.partitionBy(ORG).orderBy("model")
    return j.select(
        ORG, (F.coalesce("_v", F.lit(0)) + F.row_number().over(w)).cast("int").alias("version"),
        F.col("model").alias("algorithm"), F.lit("candidate").alias("status"),
        "mae", "rmse", "mape", "wape", "bias", "r2",
        F.lit(None).cast("double").alias("live_mae"), F.lit(None).cast("double").alias("live_wape"),
        F.lit(None).cast("double").alias("live_bias"), F.col("points").alias("evaluation_rows"),
        F.lit(json.dumps(features)).alias("features_used"),
        F.coalesce(hp[F.col("model")], F.lit("{}")).alias("hyperparameters"),
        F.lit(trained_at).cast("timestamp").alias("trained_at"), F.lit(None).cast("timestamp").alias("promoted_at"),
        F.lit(False).alias("degradation_flagged"))


def best_candidate(registry: DataFrame) -> DataFrame:
    """Per tenant, the best candidate of its newest batch (latest ``trained_at``):
    lowest WAPE, else lowest MAE. A registry without that column is one batch."""
    c = registry.filter(F.col("status") == "candidate")
    if "trained_at" in registry.columns:
        newest = registry.groupBy(ORG).agg(F.max("trained_at").alias("_t"))
        c = c.join(per_tenant(newest), ORG).filter(F.col("trained_at").eqNullSafe(F.col("_t"))).drop("_t")
    w = Window.partitionBy(ORG).orderBy(F.col("wape").asc_nulls_last(), F.col("mae").asc_nulls_last(),
                                        F.desc("version"))
    return c.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def promote(registry: DataFrame, target: DataFrame, at: str) -> DataFrame:
    """Make ``target`` (organization_id, version) active; the previous active
    version becomes archived. Exactly one active version per tenant."""
    t = target.select(ORG, F.col("version").alias("_tv"))
    j = registry.join(t, ORG, "left")
    is_t = F.col("version") == F.col("_tv")
    st = (F.when(F.col("_tv").isNull(), F.col("status"))
           .when(is_t, F.lit("active"))
           .when(F.col("status") == "active", F.lit("archived")).otherwise(F.col("status")))
    return j.withColumn("promoted_at", F.when(is_t, F.lit(at).cast("timestamp")).otherwise(F.col("promoted_at"))) \
            .withColumn("status", st).drop("_tv").select(*registry.columns)


def rollback(registry: DataFrame, at: str) -> DataFrame:
    """The active version becomes rolled_back and the most recently promoted
    archived version becomes active again."""
    prev = (registry.filter(F.col("status") == "archived")
                    .withColumn("_rn", F.row_number().over(Window.partitionBy(ORG).orderBy(
                        F.desc_nulls_last("promoted_at"), F.desc("version"))))
                    .filter("_rn = 1").select(ORG, F.col("version").alias("_pv")))
    has_active = registry.filter(F.col("status") == "active").select(ORG).distinct().withColumn("_ha", F.lit(True))
    j = registry.join(prev, ORG, "left").join(has_active, ORG, "left")
    go = F.coalesce("_ha", F.lit(False)) & F.col("_pv").isNotNull()
    st = (F.when(go & (F.col("status") == "active"), F.lit("rolled_back"))
           .when(go & (F.col("version") == F.col("_pv")), F.lit("active")).otherwise(F.col("status")))
    pa = F.when(go & (F.col("version") == F.col("_pv")), F.lit(at).cast("timestamp")).otherwise(F.col("promoted_at"))
    return j.withColumn("status", st).withColumn("promoted_at", pa).select(*registry.columns)


def active_models(registry: DataFrame) -> DataFrame:
    """G19 get_active."""
    return registry.filter(F.col("status") == "active")


def list_versions(registry: DataFrame, limit: int | None = None) -> DataFrame:
    """G19 list_versions: newest first per tenant."""
    w = Window.partitionBy(ORG).orderBy(F.desc("version"))
    r = registry.withColumn("rank", F.row_number().over(w))
    return r.filter(F.col("rank") <= limit) if limit else r


def flag_degradation(registry: DataFrame, keys: DataFrame, flag: bool = True) -> DataFrame:
    """Manually set / clear the degradation flag of (organization_id, version) rows."""
    k = keys.select(ORG, "version").withColumn("_hit", F.lit(True))
    j = registry.join(k, [ORG, "version"], "left")
    return j.withColumn("degradation_flagged", F.when(F.col("_hit"), F.lit(flag))
                        .otherwise(F.col("degradation_flagged"))).select(*registry.columns)


def with_health(registry: DataFrame, as_of, max_age_days: int = 7, bar_pct: float = 2.0) -> DataFrame:
    """Degradation flag, retrain decision and the promotion bar per row.

    * degraded: live WAPE > 1.25 × eval WAPE, or |bias| / |live WAPE| > 0.15
    * needs_retrain (per tenant): no active model, the active one is degraded /
      flagged, or it is at least ``max_age_days`` old
    * beats_active: a candidate improves WAPE (else MAE) by ≥ 2 % relative
    """
    d = registry.withColumn("degraded", degradation_flag(registry) | F.coalesce("degradation_flagged", F.lit(False)))
    act = d.filter(F.col("status") == "active").select(
        ORG, F.col("wape").alias("_aw"), F.col("mae").alias("_am"), F.col("degraded").alias("_ad"),
        F.col("trained_at").alias("_at"))
    j = d.join(act, ORG, "left")
    age = F.datediff(as_date(as_of), F.to_date("_at"))
    need = F.col("_at").isNull() | F.coalesce("_ad", F.lit(False)) | (age >= max_age_days)
    rel = F.when(F.col("_aw").isNotNull() & F.col("wape").isNotNull() & (F.col("_aw") > 0),
                 (F.col("_aw") - F.col("wape")) / F.col("_aw") * 100) \
           .when(F.col("_am").isNotNull() & (F.col("_am") > 0), (F.col("_am") - F.col("mae")) / F.col("_am") * 100)
    beats = F.when(F.col("_aw").isNull() & F.col("_am").isNull(), F.lit(True)).otherwise(
        F.coalesce(rel >= bar_pct, F.lit(False)))
    return j.withColumn("needs_retrain", need).withColumn("beats_active", (F.col("status") == "candidate") & beats) \
            .drop("_aw", "_am", "_ad", "_at")


def registry_overview(registry: DataFrame, as_of) -> DataFrame:
    """Per tenant: active version / algorithm, version count, degraded, needs retrain."""
    h = with_health(registry, as_of)
    return h.groupBy(ORG).agg(
        F.max(F.when(F.col("status") == "active", F.col("version"))).alias("active_version"),
        F.max(F.when(F.col("status") == "active", F.col("algorithm"))).alias("active_algorithm"),
        F.count(F.lit(1)).alias("versions"),
        F.max(F.when(F.col("status") == "active", F.col("degraded"))).alias("active_degraded"),
        F.max("needs_retrain").alias("needs_retrain"))


# ------------------------------------------------------- forecasts

def forecast_tables(forecast: DataFrame, model_type: str, created_at: str) -> tuple[DataFrame, DataFrame]:
    """Header (one per tenant run) and detail rows of a forecast."""
    hdr = forecast.groupBy(ORG).agg(F.sum("predicted_sales").alias("total_forecast"),
                                    F.countDistinct("date").alias("horizon_days"),
                                    F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    hdr = hdr.withColumns({"header_id": F.concat_ws(":", F.col(ORG), F.lit(created_at)),
                           "model_type": F.lit(model_type),
                           "created_at": F.lit(created_at).cast("timestamp_ntz")})
    det = forecast.join(hdr.select(ORG, "header_id"), ORG).select(
        "header_id", ORG, "item_id", "store_id", F.col("date").alias("forecast_date"), "predicted_sales")
    return hdr, det


def forecast_history(headers: DataFrame, limit: int | None = None) -> DataFrame:
    """Forecast headers per tenant, newest first; the first ``limit`` if given."""
    w = Window.partitionBy(ORG).orderBy(F.desc("created_at"), F.desc("header_id"))
    r = headers.withColumn("rank", F.row_number().over(w))
    return r if limit is None else r.filter(F.col("rank") <= limit)


def matured_accuracy(headers: DataFrame, details: DataFrame, actuals: DataFrame, as_of=None) -> DataFrame:
    """Forecasts whose date has passed (≤ as_of) joined with the actual sales
    (de-duplicated per key), accuracy per (tenant, horizon, item, store)."""
    if as_of is None:
        cut = actuals.groupBy(ORG).agg(F.max("date").alias("_asof"))
    else:
        cut = headers.select(ORG).distinct().withColumn("_asof", as_date(as_of))
    fc = (details.join(headers.select("header_id", "horizon_days"), "header_id").join(per_tenant(cut), ORG)
                 .filter(F.col("forecast_date") <= F.col("_asof")))
    act = actuals.select(ORG, "item_id", "store_id", F.col("date").alias("forecast_date"), "sales") \
                 .dropDuplicates([ORG, "item_id", "store_id", "forecast_date"])
    j = fc.join(act, [ORG, "item_id", "store_id", "forecast_date"])
    m = j.groupBy(ORG, "horizon_days", "item_id", "store_id").agg(*metric_columns("sales", "predicted_sales"))
    return m.withColumnRenamed("points", "eval_points").withColumnRenamed("item_id", "product_id")


def live_metrics(headers: DataFrame, details: DataFrame, actuals: DataFrame, as_of=None) -> DataFrame:
    """G20 live numbers pooled over every matured row of the tenant (trap 21)."""
    if as_of is None:
        cut = actuals.groupBy(ORG).agg(F.max("date").alias("_asof"))
    else:
        cut = headers.select(ORG).distinct().withColumn("_asof", as_date(as_of))
    fc = details.join(per_tenant(cut), ORG).filter(F.col("forecast_date") <= F.col("_asof"))
    act = actuals.select(ORG, "item_id", "store_id", F.col("date").alias("forecast_date"), "sales") \
                 .dropDuplicates([ORG, "item_id", "store_id", "forecast_date"])
    j = fc.join(act, [ORG, "item_id", "store_id", "forecast_date"])
    m = j.groupBy(ORG).agg(*metric_columns("sales", "predicted_sales"))
    return m.select(ORG, F.col("mae").alias("live_mae"), F.col("wape").alias("live_wape"),
                    F.col("bias").alias("live_bias"), F.col("points").alias("live_points"))


def apply_live_metrics(registry: DataFrame, live: DataFrame) -> DataFrame:
    """Write the live metrics onto each tenant's active version."""
    j = registry.join(live.select(ORG, F.col("live_mae").alias("_m"), F.col("live_wape").alias("_w"),
                                  F.col("live_bias").alias("_b")), ORG, "left")
    act = F.col("status") == "active"
    return j.withColumns({"live_mae": F.when(act & F.col("_m").isNotNull(), F.col("_m")).otherwise(F.col("live_mae")),
                          "live_wape": F.when(act & F.col("_w").isNotNull(), F.col("_w")).otherwise(F.col("live_wape")),
                          "live_bias": F.when(act & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col("live_bias"))}
                         ).select(*registry.columns)


# ------------------------------------------- the daily run's ledger

#: Sums from which every metric follows; sums of disjoint rows add up.
METRIC_SUMS = {"points": lambda a, p: F.count(F.lit(1)), "abs_error": lambda a, p: F.sum(F.abs(p - a)), "square_error": lambda a, p: F.sum((p - a) * (p - a)),
               "error": lambda a, p: F.sum(p - a), "actual": lambda a, p: F.sum(a), "square_actual": lambda a, p: F.sum(a * a),
               "abs_actual": lambda a, p: F.sum(F.abs(a)), "share": lambda a, p: F.sum(F.when(a != 0, F.abs((p - a) / a))),
               "shares": lambda a, p: F.count(F.when(a != 0, 1))}


def metrics_of_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """G10 / G11 per key from ``METRIC_SUMS``."""
    s = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in METRIC_SUMS])
    n = F.col("points")
    spread = F.col("square_actual") - F.col("actual") * F.col("actual") / n
    return s.select(
        *keys, n, (F.col("abs_error") / n).alias("mae"), F.sqrt(F.col("square_error") / n).alias("rmse"),
        F.when(spread > 1e-9 * F.col("square_actual"), 1 - F.col("square_error") / spread).alias("r2"),
        F.when(F.col("shares") > 0, F.col("share") / F.col("shares") * 100).alias("mape"),
        F.when(F.col("abs_actual") > 0, F.col("abs_error") / F.col("abs_actual") * 100).alias("wape"), (F.col("error") / n).alias("bias"),
        F.when(F.col("actual") != 0, F.col("error") / F.col("actual") * 100).alias("bias_percent"))


def _has(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def actuals_on(actuals: DataFrame, due: DataFrame, date_col: str = "date") -> DataFrame:
    """The rows of ``actuals`` of the tenants' days in ``due`` (``date_col``): of a whole history only the days that forecasts meet
    are moved by the joins that follow."""
    days = checked_broadcast(due.select(ORG, F.col(date_col).alias("date")).distinct())  # tenants x days
    return actuals.join(days, [ORG, "date"], "left_semi")


def evaluate_matured(spark, root: str, headers: DataFrame, details: DataFrame, actuals: DataFrame, as_of) -> None:
    """G20 as a run of its own day: score the (header, forecast date) pairs that have matured by ``as_of`` and that no
    earlier run has scored, and add their sums.

    ``accuracy_sums`` and ``accuracy_ledger`` hold one folder per run. The ledger's is written last and commits the run: sums
    without it do not count, and running a day again replaces both, so neither a failure nor a repeat counts a pair
    twice. Actual sales that arrive after their date was scored do not change it.
    """
    run = str(as_of)
    due = details.where(F.col("forecast_date") <= as_date(run))
    if _has(spark, f"{root}/accuracy_ledger"):
        done = spark.read.parquet(f"{root}/accuracy_ledger").where(F.col("run").cast("string") != run)
        due = due.join(done.select(ORG, "header_id", "forecast_date"), [ORG, "header_id", "forecast_date"], "left_anti")
    met = actuals_on(actuals, due, "forecast_date")
    act = met.select(ORG, "item_id", "store_id", F.col("date").alias("forecast_date"), F.col("sales").cast("double").alias("_a")).dropDuplicates(
        [ORG, "item_id", "store_id", "forecast_date"])
    rows = due.join(headers.select("header_id", "horizon_days"), "header_id").join(act, [ORG, "item_id", "store_id", "forecast_date"]).where(
        F.col("_a").isNotNull() & F.col("predicted_sales").isNotNull())
    a, p = F.col("_a"), F.col("predicted_sales")
    sums = rows.groupBy(ORG, "horizon_days", "item_id", "store_id").agg(*[f(a, p).alias(n) for n, f in METRIC_SUMS.items()])
    sums.write.mode("overwrite").parquet(f"{root}/accuracy_sums/run={run}")
    due.select(ORG, "header_id", "forecast_date").distinct().write.mode("overwrite").parquet(f"{root}/accuracy_ledger/run={run}")


def _committed_sums(spark, root: str) -> DataFrame:
    runs = spark.read.parquet(f"{root}/accuracy_ledger").select("run").distinct()
    return spark.read.parquet(f"{root}/accuracy_sums").join(F.broadcast(runs), "run", "left_semi")  # one row per day of runs


def accuracy_from_sums(spark, root: str) -> DataFrame:
    """The accuracy table (as ``matured_accuracy``) of all committed runs."""
    m = metrics_of_sums(_committed_sums(spark, root), [ORG, "horizon_days", "item_id", "store_id"])
    return m.withColumnRenamed("points", "eval_points").withColumnRenamed("item_id", "product_id")


def live_from_sums(spark, root: str) -> DataFrame:
    """Live numbers (as ``live_metrics``) of all committed runs."""
    m = metrics_of_sums(_committed_sums(spark, root), [ORG])
    return m.select(ORG, F.col("mae").alias("live_mae"), F.col("wape").alias("live_wape"), F.col("bias").alias("live_bias"), F.col("points").alias("live_points"))


def store_registry(registry: DataFrame, root: str, version: str) -> DataFrame:
    """Write the registry as version ``version`` (a day); readers take the newest complete one."""
    path = f"{root}/model_registry/version={version}"
    registry.write.mode("overwrite").parquet(path)
    return registry.sparkSession.read.parquet(path)


def current_registry(spark, root: str) -> DataFrame:
    """The newest stored registry whose write was completed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/model_registry")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    Path = spark._jvm.org.apache.hadoop.fs.Path
    whole = [f.getPath().toString() for f in fs.listStatus(p) if fs.exists(Path(f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(whole))


def auto_retrain(registry: DataFrame, fact: DataFrame, compare, as_of, max_age_days: int = 7, bar_pct: float = 2.0) -> DataFrame:
    """Tenants whose active model is missing, degraded, flagged or ``max_age_days`` old are retrained (``compare``:
    their sales rows -> comparison); their best new candidate is promoted if it beats the active one by ``bar_pct``."""
    at = f"{as_of} 00:00:00"
    health = with_health(registry, as_of, max_age_days, bar_pct)
    due = fact.select(ORG).distinct().join(health.where(~F.col("needs_retrain")).select(ORG).distinct(), ORG, "left_anti")
    due = materialize(due, "due-tenants")  # one row per tenant
    comparison = materialize(compare(fact.join(per_tenant(due), ORG, "left_semi")), "comparison")
    new = register_candidates(comparison, registry, due, [], {}, at)
    both = materialize(registry.unionByName(new), "registry")
    best = best_candidate(both).select(ORG, "version").join(new.select(ORG, "version"), [ORG, "version"], "left_semi")
    clear = with_health(both, as_of, max_age_days, bar_pct).where("beats_active").select(ORG, "version")
    return promote(both, best.join(clear, [ORG, "version"], "left_semi"), at)


def accuracy_summary(accuracy: DataFrame) -> DataFrame:
    """By horizon: means of non-NULL metrics, total points."""
    return accuracy.groupBy(ORG, "horizon_days").agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape"),
        F.avg("wape").alias("wape"), F.avg("bias").alias("bias"), F.sum("eval_points").alias("eval_points"),
        F.count(F.lit(1)).alias("series"))


def accuracy_listing(accuracy: DataFrame, horizon: int | None = None, product: str | None = None,
                     store: str | None = None) -> DataFrame:
    """G23 listing with optional filters (pushed down like any filter)."""
    a = accuracy
    if horizon is not None:
        a = a.filter(F.col("horizon_days") == horizon)
    if product is not None:
        a = a.filter(F.col("product_id") == product)
    if store is not None:
        a = a.filter(F.col("store_id") == store)
    return a


def training_history(history: DataFrame, limit: int | None = None) -> DataFrame:
    """Training runs per tenant, newest first (the first ``limit`` if given), and the current best (``is_best``)."""
    w = Window.partitionBy(ORG).orderBy(F.desc("trained_at"), "model")
    r = history.withColumn("rank", F.row_number().over(w))
    return r if limit is None else r.filter(F.col("rank") <= limit)


def current_best(history: DataFrame) -> DataFrame:
    """Of each tenant's newest training run (latest ``trained_at``) the model marked best."""
    newest = history.groupBy(ORG).agg(F.max("trained_at").alias("_t"))
    return history.join(per_tenant(newest), ORG).where((F.col("trained_at") == F.col("_t")) & F.col("is_best")).drop("_t")
