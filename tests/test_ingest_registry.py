"""Ingest / upsert / tenancy goldens, streaming = batch, alert dedupe, registry transitions, plan checks."""

import datetime as dt
import json
import os
import tempfile
import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillsight.operators import alerts as A
from tillsight.operators import registry as R
from tillsight.session import scratch_path
from tillsight.sources import ingest as I

D = dt.date


def _root(spark):
    return scratch_path(spark, f"t-{uuid.uuid4().hex}")


def test_tenant_isolation_golden(spark):
    rows = [("2026-01-01", "SKU1", "S1", 10.0, 5.0), ("2026-01-02", "SKU1", "S1", 20.0, 5.0),
            ("2026-01-03", "SKU2", "S1", 30.0, 8.0)]
    df = spark.createDataFrame(rows, "date string, item_id string, store_id string, sales double, sell_price double")
    root = _root(spark)
    res = I.ingest(spark, root, df, "A")
    assert res["rows_imported"] == 3 and res["products"] == 2 and res["stores"] == 1
    s = spark.read.parquet(f"{root}/sales")
    a = I.table_summary(s).filter(F.col("organization_id") == "A").first()
    assert (a.sales_rows, a.products, a.stores) == (3, 2, 1)
    assert s.filter(F.col("organization_id") == "B").count() == 0
    assert sorted(r.revenue for r in s.collect()) == [50.0, 100.0, 240.0]


def test_ingest_twice_is_idempotent(spark):
    df = spark.createDataFrame([("2026-01-01", "SKU1", "S1", 10.0), ("2026-01-02", "SKU1", "S1", 20.0)],
                               "date string, item_id string, store_id string, sales double")
    root = _root(spark)
    I.ingest(spark, root, df, "A")
    second = I.ingest(spark, root, df, "A")
    assert second["products"] == 0
    assert spark.read.parquet(f"{root}/sales").count() == 2
    assert spark.read.parquet(f"{root}/products").count() == 1
    assert spark.read.parquet(f"{root}/import_jobs").count() == 2


def test_dirty_upload_cleaning(spark):
    rows = [("2026-01-01", "p1", "10", "2.5"), ("not a date", "p1", "5", "1"), ("2026-01-01", "p1", "7", "1"),
            ("2026-01-02", "p2", "-3", None), ("2026-01-03", "p3", "abc", "1")]
    df = spark.createDataFrame(rows, "Transaction_Date string, SKU string, QTY string, Unit_Price string")
    out = {(r.date, r.item_id): r for r in I.clean_batch(df, "A").collect()}
    assert set(out) == {(D(2026, 1, 1), "p1"), (D(2026, 1, 2), "p2"), (D(2026, 1, 3), "p3")}
    assert out[(D(2026, 1, 1), "p1")].sales == 10.0  # first row of the key kept
    assert out[(D(2026, 1, 2), "p2")].sales == 0.0 and out[(D(2026, 1, 2), "p2")].sell_price == 0.0
    assert out[(D(2026, 1, 3), "p3")].sales == 0.0  # kept: a price column exists
    assert all(r.store_id == "STORE_001" for r in out.values())
    v = I.validate_upload(df).first()
    assert v.has_store_id is False and v.bad_dates == 1 and v.negative_sales == 1 and v.non_numeric_sales == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 3), st.floats(0, 100, allow_nan=False)),
                min_size=1, max_size=12), st.integers(1, 11))
def test_upsert_split_invariance(spark, rows, cut):
    """Upserting a batch whole or as two consecutive parts gives the same table
    (later rows win either way for a key)."""
    recs = [("A", f"I{i}", "S", D(2026, 1, d), q) for i, d, q in rows]
    # keep the last occurrence per key so both orders agree
    last = {}
    for r in recs:
        last[(r[0], r[1], r[2], r[3])] = r
    schema = "organization_id string, item_id string, store_id string, date date, sales double"
    whole = I.merge_by_key(None, spark.createDataFrame(list(last.values()), schema), I.SALES_KEY)
    cut = min(cut, len(recs))
    first = {}
    for r in recs[:cut]:
        first[(r[0], r[1], r[2], r[3])] = r
    second = {}
    for r in recs[cut:]:
        second[(r[0], r[1], r[2], r[3])] = r
    a = I.merge_by_key(None, spark.createDataFrame(list(first.values()), schema), I.SALES_KEY)
    b = I.merge_by_key(a, spark.createDataFrame(list(second.values()) or [], schema), I.SALES_KEY)
    assert sorted(b.collect()) == sorted(whole.collect())


def test_stream_equals_batch(spark):
    land = tempfile.mkdtemp(prefix="land-", dir="/tmp")
    rows = [{"day": f"2026-01-{d:02d}", "product": f"P{p}", "units": float(d * p)} for d in range(1, 7) for p in (1, 2)]
    for k in range(3):  # three files -> three micro-batches
        with open(os.path.join(land, f"part-{k}.json"), "w") as fh:
            for r in rows[k * 4:(k + 1) * 4]:
                fh.write(json.dumps(r) + "\n")
    from tillsight.streaming import ingest as M
    schema = "day string, product string, units double"
    root = _root(spark)
    q = M.ingest_stream(M.pushed_stream(spark, land, schema, "json", max_files=1), f"{root}/sales",
                        f"{root}/_ckpt", "A", order="_pos")
    q.awaitTermination()
    streamed = spark.read.parquet(f"{root}/sales").select("organization_id", "item_id", "store_id", "date", "sales")
    batch = I.clean_batch(spark.read.schema(schema).json(land), "A").select(
        "organization_id", "item_id", "store_id", "date", "sales")
    assert sorted(streamed.collect()) == sorted(batch.collect())


def _alert_rows(spark):
    dec = spark.createDataFrame(
        [("A", "I1", "S1", 2.0, 10.0, 30.0, 2.0, 0.0), ("A", "I2", "S1", None, 500.0, 0.0, 999.0, 1234.5)],
        "organization_id string, item_id string, store_id string, stockout_in_days double, current_stock double, "
        "recommended_order_qty double, days_of_stock double, overstock_capital double")
    return A.stockout_alerts(dec).unionByName(A.overstock_alerts(dec))


def test_alert_messages_and_dedupe(spark):
    c = _alert_rows(spark)
    got = {r.alert_type: r for r in c.collect()}
    assert got["stockout_risk"].severity == "critical"
    assert got["stockout_risk"].message == "Stock runs out in ~2 days. Order 30 units now."
    assert got["overstock"].message == "999 days of stock ($1,234 tied up)."
    table = A.to_table_rows(A.new_alerts(c, None), "2026-01-01 00:00:00")
    assert A.new_alerts(c, table).count() == 0  # already open -> not emitted again
    resolved = A.mark(table, table.filter(F.col("alert_type") == "overstock"), resolve=True, at="2026-01-02 00:00:00")
    again = A.new_alerts(c, resolved).collect()
    assert [r.alert_type for r in again] == ["overstock"]  # resolved alerts may reopen
    counts = A.alert_counts(resolved).first()
    assert counts.open == 1 and counts.critical == 1 and counts.unread == 1


def test_registry_promote_and_rollback(spark):
    reg = spark.createDataFrame(
        [("A", 1, "rf", "active", 10.0, 20.0, None), ("A", 2, "gbt", "candidate", 9.0, 18.0, None),
         ("A", 3, "base", "candidate", 12.0, 30.0, None)],
        "organization_id string, version int, algorithm string, status string, mae double, wape double, "
        "promoted_at timestamp")
    best = R.best_candidate(reg).first()
    assert best.version == 2
    p = R.promote(reg, reg.filter("version = 2"), "2026-01-02 00:00:00")
    st_ = {r.version: r.status for r in p.collect()}
    assert st_ == {1: "archived", 2: "active", 3: "candidate"}
    assert p.filter("status = 'active'").count() == 1
    rb = R.rollback(p, "2026-01-03 00:00:00")
    assert {r.version: r.status for r in rb.collect()} == {1: "active", 2: "rolled_back", 3: "candidate"}


def test_degradation_and_retrain(spark):
    reg = spark.createDataFrame(
        [("A", 1, "active", 10.0, 20.0, 30.0, 1.0, False, "2026-01-01 00:00:00"),
         ("A", 2, "candidate", 9.0, 19.0, None, None, False, "2026-01-05 00:00:00"),
         ("B", 1, "active", 10.0, 20.0, 21.0, 5.0, False, "2026-01-09 00:00:00")],
        "organization_id string, version int, status string, mae double, wape double, live_wape double, "
        "live_bias double, degradation_flagged boolean, trained_at string"
    ).withColumn("trained_at", F.col("trained_at").cast("timestamp"))
    h = {(r.organization_id, r.version): r for r in R.with_health(reg, "2026-01-10").collect()}
    assert h[("A", 1)].degraded is True  # 30 > 1.25 × 20
    assert h[("B", 1)].degraded is True  # |5| / 21 > 0.15
    assert h[("A", 1)].needs_retrain is True
    assert h[("A", 2)].beats_active is True  # (20 - 19) / 20 = 5 % ≥ 2 %


def test_scan_is_pruned_and_no_python_in_hot_path(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    from tillsight.sources.tables import SalesTables
    df = E.queries()["h11_purchase_decisions"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    derive = SalesTables(spark, SF_SMALL, stored=False).fact()
    dplan = derive._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in dplan.splitlines() if "lineitem" in ln]
    assert scans and all("l_discount" not in ln and "l_returnflag" not in ln for ln in scans)
    assert "BroadcastHashJoin" in dplan  # small dimensions broadcast after their counted bound


def test_register_candidates_and_overview(spark):
    comp = spark.createDataFrame(
        [("baseline", 10, 5.0, 6.0, 0.1, 50.0, 40.0, 0.0, 0.0, 0.1, None),
         ("random_forest", 10, 3.0, 4.0, 0.6, 30.0, 25.0, 0.1, 1.0, 2.0, None),
         ("xgboost", None, None, None, None, None, None, None, None, None, "boom")],
        "model string, points long, mae double, rmse double, r2 double, mape double, wape double, bias double, "
        "bias_percent double, training_time_sec double, error string")
    tenants = spark.createDataFrame([("A",), ("B",)], "organization_id string")
    reg = R.register_candidates(comp, None, tenants, ["f1", "f2"], {"random_forest": {"numTrees": 100}},
                                "2026-01-01 00:00:00")
    assert reg.count() == 4  # failed model not registered
    assert sorted(r.version for r in reg.filter("organization_id = 'A'").collect()) == [1, 2]
    best = R.best_candidate(reg).collect()
    assert {r.algorithm for r in best} == {"random_forest"}
    promoted = R.promote(reg, R.best_candidate(reg).select("organization_id", "version"), "2026-01-02 00:00:00")
    ov = {r.organization_id: r for r in R.registry_overview(promoted, "2026-01-05").collect()}
    assert ov["A"].active_algorithm == "random_forest" and ov["A"].versions == 2
    assert ov["A"].needs_retrain is False  # 4 days old, not degraded
    flagged = R.flag_degradation(promoted, promoted.filter("status = 'active' AND organization_id = 'B'"))
    ovf = {r.organization_id: r for r in R.registry_overview(flagged, "2026-01-05").collect()}
    assert ovf["B"].active_degraded is True and ovf["B"].needs_retrain is True


def test_daily_recompute_over_ingested_tables(spark):
    from tillsight.streaming import ingest as M
    rows = [(f"2026-01-{d:02d}", f"P{p}", "S1", float(d + p), 2.0) for d in range(1, 29) for p in range(3)]
    df = spark.createDataFrame(rows, "date string, sku string, store string, qty double, price double")
    root = _root(spark)
    I.ingest(spark, root, df, "A")
    out = M.run_daily(spark, root)
    assert out["decisions"].count() == 3
    assert out["insights"].filter(F.col("insight_type") == "overall").count() == 1
