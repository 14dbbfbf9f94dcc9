"""Wide-file ingest (A01/A02, B09-B12), weather reshaping (F11), sampling (B18/C13),
alert stream (M05), report / snapshot payloads (I14/I16), brute-force checks."""

import datetime as dt
import os
import tempfile
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillsight.operators import alerts as A
from tillsight.operators import calendar as K
from tillsight.operators import insights as INS
from tillsight.operators import inventory as H
from tillsight.session import scratch_path
from tillsight.sources import ingest as I
from tillsight.sources.tables import SalesTables

D = dt.date


def test_wide_files_to_long_frame(spark):
    """A01/A02 + B09-B12 on wide CSVs derived from the fact of one tenant."""
    t = SalesTables(spark, SF_SMALL)
    fact = t.fact().filter(F.col("organization_id") == "ASIA").filter(F.col("date") < "1995-03-01")
    dates = [r.date for r in fact.select("date").distinct().orderBy("date").collect()]
    cal = pd.DataFrame({"date": [d.isoformat() for d in dates], "wm_yr_wk": [11101 + i // 7 for i in range(len(dates))],
                        "event_name_1": [None] * len(dates)})
    day = {d: f"d_{i + 1}" for i, d in enumerate(dates)}
    pdf = fact.toPandas()
    pdf["d"] = pdf["date"].map(day)
    wide = pdf.pivot_table(index=["item_id", "store_id"], columns="d", values="sales", aggfunc="sum").reset_index()
    wide = wide[["item_id", "store_id"] + [day[d] for d in dates]].fillna(0)
    prices = pdf.assign(wm_yr_wk=pdf["d"].map(dict(zip(cal.index.map(lambda i: f"d_{i + 1}"), cal["wm_yr_wk"]))))
    prices = prices.groupby(["store_id", "item_id", "wm_yr_wk"], as_index=False)["sell_price"].mean()
    root = tempfile.mkdtemp(prefix="wide-", dir="/tmp")
    wide.to_csv(f"{root}/sales.csv", index=False)
    cal.to_csv(f"{root}/calendar.csv", index=False)
    prices.to_csv(f"{root}/prices.csv", index=False)
    stores = sorted(pdf["store_id"].unique())[:2]
    w = I.read_wide_sales(spark, f"{root}/sales.csv", stores)
    base = I.build_base(w, I.read_calendar(spark, f"{root}/calendar.csv"), I.read_prices(spark, f"{root}/prices.csv"))
    got = base.select("item_id", "store_id", "date", "sales").toPandas()
    want = pdf[pdf["store_id"].isin(stores) & (pdf["sales"] > 0)][["item_id", "store_id", "date", "sales"]]
    key = ["item_id", "store_id", "date"]
    got = got.sort_values(key).reset_index(drop=True)
    want = want.sort_values(key).reset_index(drop=True)
    assert len(got) == len(want)
    assert (got["sales"].to_numpy() == want["sales"].to_numpy()).all()
    cleaned = I.clean_calendar(I.read_calendar(spark, f"{root}/calendar.csv")).first()
    assert cleaned.event_name_1 == "None"


def test_three_hourly_weather_to_daily(spark):
    rows = [(dt.datetime(2025, 6, 1, h), 30.0 + h / 3, 31.0, 28.0 + h / 3, 33.0, 40.0, 1000.0, 2.0 + h, 1.0,
             "Clear" if h < 12 else "Rain", "sky") for h in range(0, 24, 3)]
    df = spark.createDataFrame(rows, "datetime timestamp, temperature_c double, feels_like_c double, temp_min_c double, "
                                     "temp_max_c double, humidity_pct double, pressure_hpa double, "
                                     "wind_speed_ms double, rain_3h_mm double, weather_condition string, "
                                     "weather_description string")
    r = K.daily_weather(df).first()
    assert r.temp_c == pytest.approx(sum(30.0 + h / 3 for h in range(0, 24, 3)) / 8)
    assert r.temp_min_c == 28.0 and r.wind_speed_ms == 23.0 and r.rain_mm == 8.0
    assert r.weather_condition == "Clear"  # tie 4 / 4 -> smallest, as the first pandas mode
    assert r.season == "Summer"


def test_sample_series_is_repeatable_and_whole(spark):
    fact = SalesTables(spark, SF_SMALL).fact()
    a = I.sample_series(fact, 3)
    b = I.sample_series(fact, 3)
    assert sorted(a.collect()) == sorted(b.collect())
    per = a.groupBy("organization_id").agg(F.countDistinct("item_id", "store_id").alias("n")).collect()
    assert all(r.n == 3 for r in per)
    # every row of a kept series is kept (semi join, no row cap)
    keys = a.select("organization_id", "item_id", "store_id").distinct()
    assert fact.join(keys, ["organization_id", "item_id", "store_id"], "left_semi").count() == a.count()


def test_alert_stream_emits_only_new(spark):
    from tillsight.streaming import ingest as M
    land = tempfile.mkdtemp(prefix="alerts-", dir="/tmp")
    dec = spark.createDataFrame(
        [("A", "I1", "S1", 2.0, 10.0, 30.0, 2.0, 0.0)],
        "organization_id string, item_id string, store_id string, stockout_in_days double, current_stock double, "
        "recommended_order_qty double, days_of_stock double, overstock_capital double")
    cand = A.stockout_alerts(dec)
    cand.write.mode("overwrite").parquet(f"{land}/b1")
    cand.write.mode("overwrite").parquet(f"{land}/b2")
    root = scratch_path(spark, f"al-{uuid.uuid4().hex}")
    for part in ("b1", "b2"):
        stream = spark.readStream.schema(cand.schema).parquet(f"{land}/{part}")
        M.alert_stream(stream, f"{root}/alerts", f"{root}/_ckpt_{part}").awaitTermination()
    assert spark.read.parquet(f"{root}/alerts").count() == 1


def test_snapshot_and_report_payloads(spark):
    t = SalesTables(spark, SF_SMALL)
    fact = t.fact()
    dec = H.purchase_decisions(H.series_stats(fact, t.stock()))
    fin = H.financial_summary(dec)
    snap = INS.business_snapshot(fact, dec, fin, INS.store_intelligence(fact), INS.product_intelligence(fact), top_k=12)
    assert set(snap) >= {"sales", "financials", "top_reorder_items", "stockout_risks", "stores", "products"}
    assert snap["top_reorder_items"].groupBy("organization_id").count().agg(F.max("count")).first()[0] <= 12
    whole = INS.business_snapshot(fact, dec, fin, INS.store_intelligence(fact), INS.product_intelligence(fact))
    assert whole["top_reorder_items"].count() == dec.count()  # no cap unless asked for
    rep = INS.report_payload(fact, dec, fin, max_decisions=200)
    assert rep["summary"].count() == fact.select("organization_id").distinct().count()
    assert rep["decisions"].groupBy("organization_id").count().agg(F.max("count")).first()[0] <= 200


def test_holiday_distances_brute_force(spark):
    """F05 against a direct Python scan of the holiday set on the sf0.001 dates."""
    fact = SalesTables(spark, SF_SMALL).fact()
    feats = {(r.organization_id, r.date): r for r in K.holiday_date_features(fact).collect()}
    hol = {}
    for r in K.holiday_calendar(fact).collect():
        hol.setdefault(r.organization_id, set()).add(r.holiday_date)
    for (org, d), r in list(feats.items())[:400]:
        hs = hol[org]
        nxt = next((k for k in range(0, 91) if d + dt.timedelta(days=k) in hs), 30)
        prv = next((k for k in range(0, 91) if d - dt.timedelta(days=k) in hs), 30)
        assert (r.days_to_holiday, r.days_since_holiday) == (nxt, prv)
