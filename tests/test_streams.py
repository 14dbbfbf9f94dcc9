"""Corrections in streamed aggregates, and the daily run over a ledger."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tillsight.session import scratch_path
from tillsight.sources import ingest as I
from tillsight.streaming import ingest as M

PUSHED = "ts timestamp, store string, item string, qty double, n long"


def _push(spark, root, rows, watermark="3 days"):
    df = spark.createDataFrame(rows, PUSHED)
    df.coalesce(1).write.mode("append").parquet(f"{root}/pushed")
    stream = M.pushed_stream(spark, f"{root}/pushed", df.schema, "parquet")
    M.corrected_daily_stream(stream, f"{root}/daily", f"{root}/_ckpt", "ts", ["store"], "item", "qty", "n", watermark).awaitTermination()
    return {(str(r.day), r.store): (r.total, r.item_count) for r in spark.read.parquet(f"{root}/daily").collect()}


def at(day, hour=12):
    return dt.datetime(2024, 5, day, hour)


def test_a_corrected_row_replaces_the_earlier_one(spark):
    root = scratch_path(spark, f"corrected-{uuid.uuid4().hex}")
    assert _push(spark, root, [(at(1), "S", "a", 10.0, 1), (at(1, 23), "S", "b", 5.0, 1), (at(1, 0), "T", "a", 1.0, 1)]) == {
        ("2024-05-01", "S"): (15.0, 2), ("2024-05-01", "T"): (1.0, 1)}
    # a correction, a repeated row, two rows of one item in one file (the later order wins), a new day and item
    assert _push(spark, root, [(at(1), "S", "a", 7.0, 2), (at(1), "T", "a", 1.0, 1), (at(2), "S", "c", 4.0, 3), (at(2, 1), "S", "c", 3.0, 4)]) == {
        ("2024-05-01", "S"): (12.0, 2), ("2024-05-01", "T"): (1.0, 1), ("2024-05-02", "S"): (3.0, 1)}
    _push(spark, root, [(at(20), "S", "a", 1.0, 9)])  # the watermark passes the first days
    late = _push(spark, root, [(at(1), "S", "a", 100.0, 10), (at(20), "S", "a", 2.0, 11)])
    assert late[("2024-05-01", "S")] == (12.0, 2) and late[("2024-05-20", "S")] == (2.0, 1)


def test_a_replayed_batch_is_added_once(spark):
    root = scratch_path(spark, f"replayed-{uuid.uuid4().hex}")
    want = None
    for _ in range(2):
        got = _push(spark, root, [(at(1), "S", "a", 10.0, 1)]) if want is None else None
        want = want or got
    # forget the commit of the last micro-batch: it runs again from the state before it
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_ckpt/commits")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    _push(spark, root, [(at(1), "S", "a", 6.0, 2), (at(1), "S", "b", 1.0, 2)])
    commits = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().isdigit()]
    fs.delete(max(commits, key=lambda c: int(c.getName())), False)
    again = _push(spark, root, [(at(3), "S", "z", 2.0, 3)])
    assert again == {("2024-05-01", "S"): (7.0, 2), ("2024-05-03", "S"): (2.0, 1)}


def test_the_ledger_counts_every_pair_once(spark):
    from tillsight.operators import registry as R
    root = scratch_path(spark, f"ledger-{uuid.uuid4().hex}")
    days = [dt.date(2024, 5, d) for d in range(1, 11)]
    fact = spark.createDataFrame([("A", i, "S", d, float(d.day + k)) for k, i in enumerate("xy") for d in days],
                                 "organization_id string, item_id string, store_id string, date date, sales double")
    fc = fact.withColumn("predicted_sales", F.col("sales") * F.when(F.col("date") > "2024-05-05", 1.5).otherwise(0.5))
    headers, details = R.forecast_tables(fc, "m", "2024-04-30 00:00:00")
    want = {r.product_id: r for r in R.matured_accuracy(headers, details, fact).collect()}
    step = lambda day, rows=fact: R.evaluate_matured(spark, root, headers, details, rows, day)
    step("2024-05-04")
    assert {r.eval_points for r in R.accuracy_from_sums(spark, root).collect()} == {4}
    step("2024-05-04")  # again: replaced, not added
    step("2024-05-07")
    # a run whose ledger was not written does not count, and a later run scores its pairs
    step("2024-05-08")
    I._delete(spark, f"{root}/accuracy_ledger/run=2024-05-08")
    assert {r.eval_points for r in R.accuracy_from_sums(spark, root).collect()} == {7}
    step("2024-05-31")
    for r in R.accuracy_from_sums(spark, root).collect():
        w = want[r.product_id]
        assert r.eval_points == 10 == w.eval_points
        for m in ("mae", "rmse", "r2", "mape", "wape", "bias", "bias_percent"):
            assert abs(r[m] - w[m]) < 1e-9
    live, whole = R.live_from_sums(spark, root).collect()[0], R.live_metrics(headers, details, fact).collect()[0]
    assert all(abs(live[c] - whole[c]) < 1e-9 for c in ("live_mae", "live_wape", "live_bias", "live_points"))


def test_only_due_tenants_are_retrained(spark):
    from tillsight.operators import registry as R
    comp = spark.createDataFrame([(o, m, 10, w, w, None) for o in "ABC" for m, w in (("m1", 5.0), ("m2", 4.0))],
                                 "organization_id string, model string, points long, mae double, wape double, error string")
    for c in ("rmse", "r2", "mape", "bias"):
        comp = comp.withColumn(c, F.lit(1.0))
    old = R.register_candidates(comp.where("model = 'm1' and organization_id <> 'C'"), None, comp.select("organization_id").distinct(), [], {}, "2024-05-01 00:00:00")
    reg = R.promote(old, old.select("organization_id", "version"), "2024-05-01 00:00:00")
    reg = reg.withColumn("trained_at", F.when(F.col("organization_id") == "B", F.lit("2024-05-09").cast("timestamp")).otherwise(F.col("trained_at")))
    fact = spark.createDataFrame([(o,) for o in "ABC"], "organization_id string")
    asked = []

    def compare(rows):
        asked.append(sorted(r[0] for r in rows.collect()))
        return comp.join(rows, "organization_id", "left_semi")

    got = {(r.organization_id, r.version): (r.algorithm, r.status) for r in R.auto_retrain(reg, fact, compare, "2024-05-10").collect()}
    assert asked == [["A", "C"]]  # B's model is a day old
    assert got == {("A", 1): ("m1", "archived"), ("A", 2): ("m1", "candidate"), ("A", 3): ("m2", "active"), ("B", 1): ("m1", "active"),
                   ("C", 1): ("m1", "candidate"), ("C", 2): ("m2", "active")}
