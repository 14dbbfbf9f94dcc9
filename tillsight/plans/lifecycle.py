"""Registered queries of the model registry's life and of the whole ingest.

Registry: two SQL-checkable models (each series' mean, and the tenant's mean of
means) are evaluated on the forecast days, registered as candidates twice, and
carried through promotion, rollback, live monitoring and the retrain decision.

Ingest: every lineitem row is pushed as an upload row (its ship date, with every
97th one unreadable; its quantity; its price, with every 11th one missing; every
5th one a stock count) and ingested twice into a scratch folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillsight.functions.core import ORG, per_tenant
from tillsight.operators import alerts as A
from tillsight.operators import models as G
from tillsight.operators import registry as R
from tillsight.plans.catalog import query, r4, with_fact
from tillsight.plans.models import BASE_SQL, METRICS_SQL, _baseline_fc
from tillsight.session import scratch_path
from tillsight.sources import ingest as I
from tillsight.sources.tables import materialize, read_table
from tillsight.streaming import ingest as M

FIRST, SECOND, NOW = "2001-11-01 00:00:00", "2001-11-08 00:00:00", "2001-11-12"


def _stored_fc(spark, sf):
    """The fact and its baseline forecast, stored: every step that follows reads it."""
    fact, fc = _baseline_fc(spark, sf)
    return fact, materialize(fc, "forecast")


def _comparison(spark, sf, given=None):
    """Per tenant and model: metrics on the forecast days (``given``: fact and stored forecast)."""
    fact, fc = given or _stored_fc(spark, sf)
    means = fc.select(*G.SERIES, F.col("predicted_sales").alias("_m")).distinct().groupBy(ORG).agg(F.avg("_m").alias("_g"))
    flat = fc.join(per_tenant(means), ORG).withColumn("predicted_sales", F.col("_g")).drop("_g")
    act = R.actuals_on(fact.select(*G.SERIES, "date", "sales"), fc)
    parts = [G.metrics(p.join(act, [*G.SERIES, "date"]), [ORG], "sales", "predicted_sales").withColumn("model", F.lit(n))
             for n, p in (("series_mean", fc), ("tenant_mean", flat))]
    return parts[0].unionByName(parts[1]).withColumn("error", F.lit(None).cast("string"))


def _registry(spark, sf):
    """Two batches of candidates, the best of each promoted in turn."""
    comp = materialize(_comparison(spark, sf), "comparison")
    tenants = comp.select(ORG).distinct()
    one = R.register_candidates(comp, None, tenants, ["sales"], {}, FIRST)
    one = R.promote(one, R.best_candidate(one).select(ORG, "version"), FIRST)
    both = one.unionByName(R.register_candidates(comp, one, tenants, ["sales"], {}, SECOND))
    both = materialize(both, "registry")
    return R.promote(both, R.best_candidate(both).select(ORG, "version"), SECOND)


REG_SQL = f"""{BASE_SQL},
jg AS (SELECT j.organization_id, j.sales, gm.global_mean AS predicted_sales FROM j JOIN gm USING (organization_id)),
cmp AS (SELECT 'series_mean' AS model, organization_id, {METRICS_SQL} FROM j GROUP BY organization_id
        UNION ALL SELECT 'tenant_mean', organization_id, {METRICS_SQL} FROM jg GROUP BY organization_id),
cand AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY model) AS v,
                row_number() OVER (PARTITION BY organization_id ORDER BY wape NULLS LAST, mae NULLS LAST, model DESC) AS best FROM cmp),
reg AS (SELECT organization_id, CAST(v AS BIGINT) AS version, model AS algorithm, mae, wape, points,
               CASE WHEN best = 1 THEN 'archived' ELSE 'candidate' END AS status FROM cand
        UNION ALL SELECT organization_id, CAST(v + 2 AS BIGINT), model, mae, wape, points,
               CASE WHEN best = 1 THEN 'active' ELSE 'candidate' END FROM cand)"""


@query("g18_best_candidate", with_fact(f"""WITH {REG_SQL}
SELECT organization_id, version, algorithm, round(mae, 4) AS mae, round(wape, 4) AS wape, CAST(points AS BIGINT) AS evaluation_rows
FROM reg WHERE status = 'active'"""))
def g18(spark, sf):
    """The best candidate of each tenant's newest batch (older batches hold equal ones)."""
    comp = materialize(_comparison(spark, sf), "comparison")
    tenants = comp.select(ORG).distinct()
    one = R.register_candidates(comp, None, tenants, ["sales"], {}, FIRST)
    both = one.unionByName(R.register_candidates(comp, one, tenants, ["sales"], {}, SECOND))
    return R.best_candidate(both).select(ORG, "version", "algorithm", "mae", "wape", "evaluation_rows")


@query("g19_registry_after_promotions", with_fact(f"""WITH {REG_SQL}
SELECT organization_id, version, algorithm, status FROM reg"""))
def g19(spark, sf):
    """Versions and statuses after two batches were registered and promoted."""
    return _registry(spark, sf).select(ORG, "version", "algorithm", "status")


@query("g19_registry_after_rollback", with_fact(f"""WITH {REG_SQL}
SELECT organization_id, version, algorithm,
  CASE status WHEN 'active' THEN 'rolled_back' WHEN 'archived' THEN 'active' ELSE status END AS status FROM reg"""))
def g19r(spark, sf):
    """Versions and statuses after the second promotion was rolled back."""
    return R.rollback(_registry(spark, sf), SECOND).select(ORG, "version", "algorithm", "status")


def _live(spark, sf):
    """The registry with live accuracy on its active rows: the daily totals' forecast."""
    fact, fc = _baseline_fc(spark, sf)
    live = G.evaluate_forecast(fc, fact).select(ORG, F.col("wape").alias("_w"), F.col("bias").alias("_b"))
    reg = _registry(spark, sf).drop("live_wape", "live_bias").join(per_tenant(live), ORG, "left")
    active = F.col("status") == "active"
    return reg.withColumn("live_wape", F.when(active, F.col("_w"))).withColumn("live_bias", F.when(active, F.col("_b"))).drop("_w", "_b")


HEALTH_SQL = f"""{REG_SQL},
tf AS (SELECT organization_id, date, SUM(predicted_sales) AS p FROM fc GROUP BY 1, 2),
ta AS (SELECT organization_id, date, SUM(sales) AS s FROM fact GROUP BY 1, 2),
lv AS (SELECT organization_id, CASE WHEN SUM(abs(s)) > 0 THEN SUM(abs(p - s)) / SUM(abs(s)) * 100 END AS lw, AVG(p - s) AS lb
       FROM tf JOIN ta USING (organization_id, date) GROUP BY 1),
h AS (SELECT reg.*, lw, lb, status = 'active' AND lw IS NOT NULL AND reg.wape IS NOT NULL
             AND (lw > reg.wape * 1.25 OR abs(coalesce(lb, 0)) / (CASE WHEN lw = 0 THEN 1 ELSE abs(lw) END) > 0.15) AS degraded
      FROM reg LEFT JOIN lv USING (organization_id))"""


@query("g21b_flagged_versions", with_fact(f"""WITH {REG_SQL}
SELECT organization_id, version, status, version IN (1, 4) AS degradation_flagged FROM reg"""))
def g21b(spark, sf):
    """Versions after the degradation flag of two versions was set by hand, and that of a third set and cleared."""
    reg = _registry(spark, sf)
    keys = lambda *v: reg.select(ORG, "version").where(F.col("version").isin(*v))
    done = R.flag_degradation(R.flag_degradation(R.flag_degradation(reg, keys(1, 4)), keys(2)), keys(2), False)
    return done.select(ORG, "version", "status", "degradation_flagged")


@query("g24_training_history", with_fact(f"""WITH {REG_SQL},
h AS (SELECT organization_id, algorithm AS model, mae, version > 2 AS second,
             row_number() OVER (PARTITION BY organization_id, version > 2 ORDER BY mae, algorithm) = 1 AS is_best FROM reg)
SELECT organization_id, model, round(mae, 4) AS mae, is_best, is_best AND second AS current_best,
       CAST(row_number() OVER (PARTITION BY organization_id ORDER BY second DESC, model) AS BIGINT) AS rank FROM h"""))
def g24(spark, sf):
    """Training runs of each tenant, newest first, their best models and the current best."""
    comp = materialize(_comparison(spark, sf), "comparison")
    best = F.min_by("model", F.struct("mae", "model")).over(Window.partitionBy(ORG))  # a row per model
    runs = comp.select(ORG, "model", "mae", (F.col("model") == best).alias("is_best"),
                       F.explode(F.array(F.lit(FIRST).cast("timestamp"), F.lit(SECOND).cast("timestamp"))).alias("trained_at"))
    history = R.training_history(runs)
    now = R.current_best(history).select(ORG, "model", "trained_at", F.lit(True).alias("current_best"))
    return history.join(now, [ORG, "model", "trained_at"], "left").select(
        ORG, "model", "mae", "is_best", F.coalesce("current_best", F.lit(False)).alias("current_best"), "rank")


def _daily_runs(spark, sf, days):
    """The registry and accuracy tables after ``run_models`` on each of ``days``: forecasts of two
    days' runs are stored, and a registry whose active model is the tenant mean."""
    root = scratch_path(spark, f"daily-{uuid.uuid4().hex}")
    fact, fc = _stored_fc(spark, sf)
    cut = fc.groupBy(ORG).agg(F.date_add(F.min("date"), 13).alias("_cut"))
    half = fc.join(per_tenant(cut), ORG).where(F.col("date") <= F.col("_cut")).drop("_cut")
    for rows, made in ((fc, FIRST), (half, SECOND)):
        hdr, det = R.forecast_tables(rows, "baseline", made)
        hdr.write.mode("append").parquet(f"{root}/forecast_headers")
        det.write.mode("append").parquet(f"{root}/forecast_details")
    comp = materialize(_comparison(spark, sf, (fact, fc)), "comparison")
    one = R.register_candidates(comp.where("model = 'tenant_mean'"), None, comp.select(ORG).distinct(), [], {}, FIRST)
    R.store_registry(R.promote(one, one.select(ORG, "version"), FIRST), root, FIRST[:10])
    out = None
    for day in days:
        out = M.run_models(spark, root, fact, day, compare=lambda rows: comp.join(per_tenant(rows.select(ORG).distinct()), ORG, "left_semi"))
    return out


DAY_ONE, DAY_TWO = "2001-11-05", "2002-01-31"


@query("m04_daily_run", with_fact(f"""WITH {BASE_SQL},
cut AS (SELECT organization_id, MIN(date) + INTERVAL 13 DAY AS c FROM fc GROUP BY 1),
runs AS (SELECT j.*, 28 AS horizon FROM j UNION ALL SELECT j.*, 14 FROM j JOIN cut USING (organization_id) WHERE j.date <= c),
hz AS (SELECT organization_id, 28 AS horizon, COUNT(DISTINCT date) AS horizon_days FROM fc GROUP BY 1
       UNION ALL SELECT organization_id, 14, COUNT(DISTINCT date) FROM fc JOIN cut USING (organization_id) WHERE date <= c GROUP BY 1)
SELECT organization_id, horizon_days, item_id AS product_id, store_id, {METRICS_SQL.replace('COUNT(*) AS points', 'COUNT(*) AS eval_points')}
FROM runs JOIN hz USING (organization_id, horizon) GROUP BY 1, 2, 3, 4"""))
def m04(spark, sf):
    """Accuracy after two consecutive daily runs, each of which scores only newly matured forecast
    dates: the table that one full evaluation gives."""
    return _daily_runs(spark, sf, [DAY_ONE, DAY_ONE, DAY_TWO])["accuracy"]


@query("m04_retrained_registry", with_fact(f"""WITH {BASE_SQL},
jg AS (SELECT j.organization_id, j.sales, gm.global_mean AS predicted_sales FROM j JOIN gm USING (organization_id)),
cmp AS (SELECT 'series_mean' AS model, organization_id, {METRICS_SQL} FROM j GROUP BY organization_id
        UNION ALL SELECT 'tenant_mean', organization_id, {METRICS_SQL} FROM jg GROUP BY organization_id),
c AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY model) + 1 AS version,
             row_number() OVER (PARTITION BY organization_id ORDER BY wape, mae, model DESC) = 1 AS best FROM cmp),
a AS (SELECT organization_id, wape AS aw FROM cmp WHERE model = 'tenant_mean'),
p AS (SELECT organization_id, version FROM c JOIN a USING (organization_id) WHERE best AND (aw - wape) / aw * 100 >= 2.0)
SELECT organization_id, CAST(1 AS BIGINT) AS version, 'tenant_mean' AS algorithm,
       CASE WHEN organization_id IN (SELECT organization_id FROM p) THEN 'archived' ELSE 'active' END AS status FROM a
UNION ALL SELECT organization_id, CAST(version AS BIGINT), model,
       CASE WHEN (organization_id, version) IN (SELECT (organization_id, version) FROM p) THEN 'active' ELSE 'candidate' END FROM c"""))
def m04r(spark, sf):
    """The registry after a daily run of a day on which every tenant's model is too old:
    retrained, and the best candidate promoted where it is better by two percent."""
    return _daily_runs(spark, sf, [DAY_TWO])["registry"].select(ORG, "version", "algorithm", "status")


@query("g21_registry_health", with_fact(f"""WITH {HEALTH_SQL}
SELECT h.organization_id, h.version, coalesce(h.degraded, false) AS degraded, coalesce(a.degraded, false) AS needs_retrain,
  h.status = 'candidate' AND coalesce((a.wape - h.wape) / nullif(a.wape, 0) >= 0.02, false) AS beats_active
FROM h JOIN h a ON a.organization_id = h.organization_id AND a.status = 'active'"""))
def g21(spark, sf):
    """Degradation, retrain decision and promotion bar of every version, four days after training."""
    h = R.with_health(_live(spark, sf), NOW)
    return h.select(ORG, "version", "degraded", "needs_retrain", "beats_active")


@query("g25_registry_overview", with_fact(f"""WITH {HEALTH_SQL}
SELECT organization_id, CAST(MAX(CASE WHEN status = 'active' THEN version END) AS BIGINT) AS active_version,
  MAX(CASE WHEN status = 'active' THEN algorithm END) AS active_algorithm, COUNT(*) AS versions,
  bool_or(coalesce(degraded, false)) AS active_degraded, bool_or(coalesce(degraded, false)) AS needs_retrain
FROM h GROUP BY 1"""))
def g25(spark, sf):
    """Active model, number of versions, degradation and retrain decision per tenant."""
    return R.registry_overview(_live(spark, sf), NOW)


@query("j08_degradation_alerts", with_fact(f"""WITH {HEALTH_SQL}
SELECT organization_id, 'forecast_degradation' AS alert_type, 'high' AS severity, 'Forecast accuracy degraded' AS title
FROM h WHERE degraded"""))
def j08(spark, sf):
    """Alerts for active models whose live accuracy degraded."""
    return A.degradation_alerts(_live(spark, sf)).select(ORG, "alert_type", "severity", "title")


@query("g13_forecast_keys", with_fact("""
WITH mx AS (SELECT organization_id, MAX(date) AS mx FROM fact GROUP BY 1)
SELECT s.organization_id, s.item_id, s.store_id, CAST(mx.mx + to_days(CAST(h AS INTEGER)) AS DATE) AS date,
  CAST(isodow(mx.mx + to_days(CAST(h AS INTEGER))) - 1 AS BIGINT) AS dayofweek, CAST(month(mx.mx + to_days(CAST(h AS INTEGER))) AS BIGINT) AS month
FROM (SELECT DISTINCT organization_id, item_id, store_id FROM fact) s JOIN mx USING (organization_id), range(1, 29) t(h)"""))
def g13k(spark, sf):
    """Series, dates and calendar parts of the model forecast: the 28 days after the tenant's last date."""
    from tillsight.sources.tables import sales_fact
    f = sales_fact(spark, sf).select(*G.SERIES, "date", F.lit(0).alias("dayofweek"), F.lit(0).alias("month"))
    return G.future_frame(f, 28).select(*G.SERIES, "date", "dayofweek", "month")


@query("g17_error_by_category", with_fact(f"""WITH {BASE_SQL},
c AS (SELECT organization_id, item_id, store_id, date, category FROM fact)
SELECT organization_id, category, {r4('SUM(sales)', 'actual_sum')}, {r4('SUM(predicted_sales)', 'predicted_sum')},
       {r4('AVG(abs(sales - predicted_sales))', 'mae')},
       {r4('CASE WHEN SUM(sales) <> 0 THEN abs(SUM(sales) - SUM(predicted_sales)) / SUM(sales) * 100 END', 'mape_of_sums')}
FROM j JOIN c USING (organization_id, item_id, store_id, date) GROUP BY 1, 2"""))
def g17c(spark, sf):
    """Forecast error table by category."""
    fact, fc = _baseline_fc(spark, sf)
    j = fc.join(fact.select(*G.SERIES, "date", "sales", "category"), [*G.SERIES, "date"])
    return G.error_tables(j, "category", "sales", "predicted_sales")


# ------------------------------------------------------------- ingest

def _pushed(spark, sf):
    li = read_table(spark, sf, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select(
        F.when(key % 97 == 0, F.lit("no date")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Order_Date"),
        F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("SKU"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 6).cast("string")).alias("Warehouse"),
        F.when(key % 13 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("string").alias("Units"),
        F.when(key % 11 != 0, F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).cast("string").alias("Price"),
        F.when(key % 5 == 0, key % 1000).cast("string").alias("current_stock"),
        F.col("l_returnflag").alias("category"), F.col("l_orderkey").alias("_o"), F.col("l_linenumber").alias("_l"),
        F.col("l_partkey").alias("_p"), F.col("l_suppkey").alias("_s"))


ORDER = ["_o", "_l", "_p", "_s"]

INGEST_SQL = """
p AS (SELECT CASE WHEN (l_orderkey * 10 + l_linenumber) % 97 <> 0 THEN CAST(l_shipdate AS DATE) END AS date,
        'P' || CAST(l_partkey % 40 AS VARCHAR) AS item_id, 'S' || CAST(l_suppkey % 6 AS VARCHAR) AS store_id,
        CASE WHEN (l_orderkey * 10 + l_linenumber) % 13 = 0 THEN 0.0 ELSE greatest(l_quantity, 0.0) END AS sales,
        CASE WHEN (l_orderkey * 10 + l_linenumber) % 11 <> 0 THEN floor(l_extendedprice / l_quantity * 100) / 100 ELSE 0.0 END AS sell_price,
        CASE WHEN (l_orderkey * 10 + l_linenumber) % 5 = 0 THEN CAST((l_orderkey * 10 + l_linenumber) % 1000 AS DOUBLE) END AS current_stock,
        l_returnflag AS category, l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4 FROM lineitem),
c AS (SELECT * FROM p WHERE date IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY date, item_id, store_id ORDER BY o1, o2, o3, o4) = 1)"""


def _ingested(spark, sf) -> tuple[str, list]:
    """The pushed rows ingested twice: folder and the two jobs' counts."""
    root = scratch_path(spark, f"ingest-{uuid.uuid4().hex}")
    return root, [I.ingest(spark, root, _pushed(spark, sf), "acme", "push", f"job{k}", order=ORDER) for k in (1, 2)]


@query("a06_ingested_sales", f"""WITH {INGEST_SQL}
SELECT 'acme' AS organization_id, item_id, store_id, date, round(sales, 4) AS sales,
  round(sales * sell_price / nullif(sales, 0), 4) AS sell_price,
  (SELECT arg_min(category, (o1, o2, o3, o4)) FROM c x WHERE x.item_id = c.item_id) AS category FROM c""")
def a06(spark, sf):
    """Sales read back after two ingests of the same rows (A06, A08, A11; B04, B05, B06, B08)."""
    root, _ = _ingested(spark, sf)
    return I.load_sales(spark, root)


@query("a07_ingested_inventory", f"""WITH {INGEST_SQL}
SELECT 'acme' AS organization_id, item_id, store_id, arg_max(current_stock, (o1, o2, o3, o4)) AS current_stock
FROM c WHERE current_stock IS NOT NULL GROUP BY item_id, store_id""")
def a07(spark, sf):
    """Stock read back: of a series' rows the last one written stays."""
    root, _ = _ingested(spark, sf)
    return I.load_inventory(spark, root)


@query("a10_ingested_products", f"""WITH {INGEST_SQL}
SELECT 'acme' AS organization_id, item_id, item_id AS name, arg_min(category, (o1, o2, o3, o4)) AS category,
  round(arg_min(sell_price, (o1, o2, o3, o4)), 4) AS unit_price FROM c GROUP BY item_id""")
def a10(spark, sf):
    """Product dimension: the first row of each product in input order."""
    root, _ = _ingested(spark, sf)
    return spark.read.parquet(f"{root}/products").select(ORG, "item_id", "name", "category", "unit_price")


@query("a12_import_jobs", f"""WITH {INGEST_SQL}
SELECT job_id, 'acme' AS organization_id, 'push' AS source_type, 'succeeded' AS status,
  (SELECT COUNT(*) FROM lineitem) AS rows_received, (SELECT COUNT(*) FROM c) AS rows_imported
FROM (VALUES ('job1'), ('job2')) j(job_id)""")
def a12(spark, sf):
    """Job rows of the two ingests (A11 counts, A12)."""
    root, _ = _ingested(spark, sf)
    return spark.read.parquet(f"{root}/import_jobs").drop("finished_at")


@query("a11_new_dimension_counts", f"""WITH {INGEST_SQL},
n AS (SELECT COUNT(DISTINCT item_id) AS p, COUNT(DISTINCT store_id) AS s FROM c)
SELECT job_id, CASE WHEN job_id = 'job1' THEN p ELSE 0 END AS products, CASE WHEN job_id = 'job1' THEN s ELSE 0 END AS stores
FROM (VALUES ('job1'), ('job2')) j(job_id), n""")
def a11n(spark, sf):
    """New products and stores that each of the two ingests created."""
    _, jobs = _ingested(spark, sf)
    kinds = F.array(*[F.struct(F.lit(j["job_id"]).alias("job_id"), F.lit(j["products"]).cast("bigint").alias("products"),
                               F.lit(j["stores"]).cast("bigint").alias("stores")) for j in jobs])
    return spark.range(1).select(F.explode(kinds).alias("j")).select("j.*")
