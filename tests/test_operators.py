"""Hand-computed goldens, semantic traps and invariants."""

import datetime as dt
import math
from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillsight.functions import calendar as C
from tillsight.operators import calendar as K
from tillsight.operators import features as E
from tillsight.operators import health as J
from tillsight.operators import inventory as H
from tillsight.operators import models as G

Z95 = NormalDist().inv_cdf(0.95)
D = dt.date


def fact_frame(spark, rows, org="A"):
    """rows: (item, store, date, sales, price)."""
    return spark.createDataFrame(
        [(org, i, s, d, float(q), None if p is None else float(p), "CAT") for i, s, d, q, p in rows],
        "organization_id string, item_id string, store_id string, date date, sales double, sell_price double, "
        "category string")


def series(spark, sales, start=D(2025, 1, 1), item="I1", store="S1", price=5.0, org="A"):
    return fact_frame(spark, [(item, store, start + dt.timedelta(days=k), q, price) for k, q in enumerate(sales)], org)


# ------------------------------------------------------------ inventory H02-H06

def test_safety_stock_reorder_point_eoq_golden(spark):
    f = series(spark, [10, 20, 30])
    stats = H.series_stats(f, spark.createDataFrame([("A", "I1", "S1", 100.0)],
                                                    "organization_id string, item_id string, store_id string, "
                                                    "current_stock double"))
    r = H.recommendations(stats).first()
    sd = math.sqrt(((10 - 20) ** 2 + 0 + (30 - 20) ** 2) / 3)  # trap 1: population std
    ss = Z95 * sd * math.sqrt(7)
    assert r.demand_std == pytest.approx(sd)
    assert r.safety_stock == pytest.approx(ss)
    assert r.reorder_point == pytest.approx(20 * 7 + ss)
    assert r.eoq == pytest.approx(math.sqrt(2 * 20 * 365 * 100 / (10 * 0.25)))
    assert r.status == "LOW"  # 100 < ROP (≈ 232)
    assert r.days_of_stock == pytest.approx(5.0)
    assert r.stockout_date == D(2025, 1, 3) + dt.timedelta(days=5)


def test_flat_and_zero_demand(spark):
    flat = H.recommendations(H.series_stats(series(spark, [4, 4, 4, 4]))).first()
    assert flat.demand_std == pytest.approx(0.4)  # std 0 -> 0.1 × mean
    zero = H.recommendations(H.series_stats(series(spark, [0, 0, 0]))).first()
    assert zero.eoq == 0.0
    assert zero.days_of_stock == 999.0
    assert zero.stockout_date is None
    assert zero.current_stock == 10.0  # H01 estimate floor


def test_stock_estimate_uses_last_28_rows(spark):
    f = series(spark, [1.0] * 10 + [2.0] * 28)
    est = H.stock_estimate(f).first().estimated_stock
    assert est == pytest.approx(max(1.5 * 56, 10))


def test_status_bands_exhaustive_and_exclusive(spark):
    stocks = [0.0, 5.0, 50.0, 150.0, 250.0, 900.0, 5000.0]
    f = series(spark, [10, 20, 30])
    rows = []
    for s in stocks:
        st = spark.createDataFrame([("A", "I1", "S1", s)], "organization_id string, item_id string, store_id string, "
                                                           "current_stock double")
        r = H.recommendations(H.series_stats(f, st)).first()
        expect = ("CRITICAL" if s < r.safety_stock else "LOW" if s < r.reorder_point
                  else "EXCESS" if s > r.reorder_point + r.eoq else "OK")
        assert r.status == expect
        rows.append(r.status)
    assert set(rows) == {"CRITICAL", "LOW", "OK", "EXCESS"}


def test_purchase_decision_price_fallback_and_loss(spark):
    # trap 14: price 0 falls back to the unit cost; trap 26: floor of fractional days
    f = series(spark, [4, 4, 4, 4], price=0.0)
    st = spark.createDataFrame([("A", "I1", "S1", 10.0)], "organization_id string, item_id string, store_id string, "
                                                          "current_stock double")
    d = H.purchase_decisions(H.series_stats(f, st)).first()
    assert d.unit_price == 10.0
    assert d.order_today is True
    assert d.stockout_in_days == 2.5
    assert d.stockout_date == D(2025, 1, 4) + dt.timedelta(days=2)
    assert d.arrival_date == D(2025, 1, 4) + dt.timedelta(days=7)
    assert d.stockout_revenue_loss == pytest.approx(4 * 4 * 10.0)  # floor(7 - 2.5) days × 4/day × price


def test_financial_summary_order_value_uses_mean_price(spark):
    # trap 15: order value = total qty × mean price
    dec = spark.createDataFrame(
        [("A", 10.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, 5.0), ("A", 20.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 5.0)],
        "organization_id string, recommended_order_qty double, unit_price double, inventory_value double, "
        "overstock_capital double, stockout_revenue_loss double, carrying_cost double, potential_savings double, "
        "inventory_turnover double, days_of_inventory double")
    r = H.financial_summary(dec).first()
    assert r.total_recommended_order_value == pytest.approx(30 * 2.0)
    assert r.avg_inventory_turnover == 2.0  # NULLs skipped
    assert r.items_to_reorder == 2


# --------------------------------------------------------------- calendar F

def test_holiday_categories_and_multipliers(spark):
    names = ["Kashmir Day", "Air Force Day", "Eid Milad-un-Nabi", "Eid-ul-Fitr Day 2", "Ramadan Starts",
             "Independence Day", "Labour Day", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    out = df.select("name", C.holiday_category("name").alias("c")) \
            .withColumn("m", C.holiday_multiplier("c")).withColumn("p", C.holiday_pre_days("c")).collect()
    got = {r.name: (r.c, r.m, r.p) for r in out}
    assert got["Kashmir Day"] == ("other", 1.0, 0)  # trap 11
    assert got["Air Force Day"] == ("other", 1.0, 0)
    assert got["Eid Milad-un-Nabi"] == ("religious", 1.0, 0)
    assert got["Eid-ul-Fitr Day 2"] == ("eid", 1.5, 7)
    assert got["Ramadan Starts"] == ("ramadan", 1.3, 14)
    assert got["Independence Day"] == ("national", 1.2, 3)
    assert got["Labour Day"] == ("national", 1.2, 3)
    assert got[None] == ("none", 1.0, 0)


def test_holiday_edges(spark):
    days = [D(2025, 12, d) for d in range(24, 32)]
    f = fact_frame(spark, [("I", "S", d, 1, 1) for d in days])
    h = {r.date: r for r in K.holiday_date_features(f).collect()}
    assert h[D(2025, 12, 25)].is_holiday == 1 and h[D(2025, 12, 25)].days_to_holiday == 0
    assert h[D(2025, 12, 24)].days_to_holiday == 1
    assert h[D(2025, 12, 26)].days_since_holiday == 1
    # trap 8: only the frame's years count: no holiday within 90 days ahead of Dec 31 -> 30
    assert h[D(2025, 12, 31)].days_to_holiday == 30
    jan = fact_frame(spark, [("I", "S", D(2026, 1, d), 1, 1) for d in range(1, 6)])
    hj = {r.date: r for r in K.holiday_date_features(jan).collect()}
    assert hj[D(2026, 1, 1)].days_since_holiday == 30  # Dec 25 of the previous year is not seen
    assert hj[D(2026, 1, 1)].days_to_holiday == 15  # Shab-e-Miraj 2026-01-16
    for r in K.holiday_date_features(f).collect():
        assert (r.days_to_holiday == 0) == (r.is_holiday == 1)


def test_eid_windows_overlap_and_ramadan_window(spark):
    days = [D(2024, 4, d) for d in range(1, 13)] + [D(2024, 2, 27), D(2024, 3, 11), D(2024, 3, 12)]
    f = fact_frame(spark, [("I", "S", d, 1, 1) for d in days])
    h = {r.date: r for r in K.holiday_date_features(f).collect()}
    assert h[D(2024, 4, 10)].is_holiday == 1 and h[D(2024, 4, 10)].in_eid_window == 1  # trap 9
    assert h[D(2024, 4, 2)].in_eid_window == 0 and h[D(2024, 4, 3)].in_eid_window == 1
    assert h[D(2024, 2, 27)].in_ramadan_window == 1 and h[D(2024, 3, 11)].in_ramadan_window == 1
    assert h[D(2024, 3, 12)].in_ramadan_window == 0


def test_duplicate_holiday_date_keeps_fixed(spark):
    # trap 10: 2027-12-25 is Quaid-e-Azam Day and, in the 2028 table, Shab-e-Miraj
    f = fact_frame(spark, [("I", "S", D(2027, 12, 25), 1, 1), ("I", "S", D(2028, 1, 2), 1, 1)])
    n = {r.date: r.holiday_name for r in K.holiday_names(f).collect()}
    assert n[D(2027, 12, 25)] == "Quaid-e-Azam Day"


def test_demand_multiplier_golden(spark):
    a = spark.createDataFrame([("A", D(2025, 6, 1)), ("A", D(2025, 10, 15))], "organization_id string, as_of date")
    m = {r.as_of: r for r in K.demand_multiplier(a).collect()}
    assert m[D(2025, 6, 1)].multiplier == pytest.approx(round(1.15 * 1.5 * 1.2, 2))
    assert m[D(2025, 6, 1)].holiday_name == "Eid-ul-Adha Day 1"
    assert len(m[D(2025, 6, 1)].reasons) == 3
    assert m[D(2025, 10, 15)].multiplier == 1.0 and list(m[D(2025, 10, 15)].reasons) == []


def test_seasons_and_weather_rules(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "m int")
    got = [r.s for r in df.select(C.season_of_month("m").alias("s")).orderBy("m").collect()]
    assert got == ["Winter", "Winter", "Spring", "Summer", "Summer", "Summer", "Monsoon", "Monsoon", "Monsoon",
                   "Autumn", "Winter", "Winter"]
    w = spark.createDataFrame([(36.0, "Summer", ""), (31.0, "Monsoon", ""), (9.0, "Winter", "Rain"),
                               (20.0, "Spring", "")], "t double, s string, c string")
    m = [r.m for r in w.select(C.weather_impact_multiplier("t", "s", "c").alias("m")).collect()]
    assert m == pytest.approx([1.3, 1.15 * 1.1, 1.25 * 1.1, 1.0])


# ---------------------------------------------------------------- features E

def test_rolling_and_lag_match_pandas(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0]
    f = series(spark, vals)
    out = E.rolling_features(E.lag_features(f)).orderBy("date").toPandas()
    s = pd.Series(vals)
    assert pd.isna(out["sales_rolling_std_7"][0])  # std of one row is NULL in both
    pd.testing.assert_series_equal(out["sales_rolling_mean_7"], s.rolling(7, min_periods=1).mean(),
                                   check_names=False)
    pd.testing.assert_series_equal(out["sales_rolling_std_7"].astype(float), s.rolling(7, min_periods=1).std(),
                                   check_names=False)
    pd.testing.assert_series_equal(out["sales_lag_7"].astype(float), s.shift(7), check_names=False)


def test_time_features(spark):
    f = series(spark, [1.0], start=D(2024, 12, 31))
    r = E.time_features(f).first()
    assert (r.dayofweek, r.is_weekend, r.is_month_end, r.week, r.quarter) == (1, 0, 1, 1, 4)


# ------------------------------------------------------------------ metrics G

def test_metrics_golden(spark):
    df = spark.createDataFrame([("A", 1.0, 1.0), ("A", 2.0, 3.0), ("A", 3.0, 2.0), ("A", 0.0, 1.0)],
                               "organization_id string, actual double, pred double")
    r = G.metrics(df, ["organization_id"]).first()
    assert r.points == 4
    assert r.mae == pytest.approx(0.75)
    assert r.rmse == pytest.approx(math.sqrt(0.75))
    assert r.mape == pytest.approx((0 + 0.5 + 1 / 3) / 3 * 100)
    assert r.wape == pytest.approx(3 / 6 * 100)
    assert r.bias == pytest.approx(0.25)
    sst = sum((x - 1.5) ** 2 for x in (1, 2, 3, 0))
    assert r.r2 == pytest.approx(1 - 3 / sst)


def test_additive_model_recovers_trend(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=k) for k in range(120)]
    daily = spark.createDataFrame([("A", d, 10.0 + 0.5 * k) for k, d in enumerate(days)],
                                  "organization_id string, date date, sales double")
    out = G.additive_forecast(daily, horizon=7, yearly_order=1, weekly_order=1).orderBy("date").toPandas()
    fut = out[out["y"].isna()]
    assert len(fut) == 7
    assert fut["yhat"].iloc[0] == pytest.approx(10.0 + 0.5 * 120, rel=0.02)


# ---------------------------------------------------------------- health J

def test_health_score_dirty_frame(spark):
    rows = [("I1", "S1", D(2025, 1, 1), 5, 2.0), ("I1", "S1", D(2025, 1, 1), 6, 2.0),  # duplicate key
            ("I2", "S1", D(2025, 1, 3), -1, 0.0),  # negative, zero price, 1-day gap
            ("I3", "S1", D(2025, 1, 4), 2, 100.0)]  # > 10 × median price
    r = J.health_score(fact_frame(spark, rows)).first()
    assert r.duplicates == 1 and r.duplicates_status == "fail"
    assert r.date_gaps == 1 and r.coverage_status == "warn"
    assert r.negative_sales == 1 and r.negative_status == "warn"
    assert r.zero_prices == 1 and r.high_prices == 1 and r.price_status == "warn"
    assert r.score == 100 - 20 - 8 - 8 - 8


def test_daily_anomalies_spike_and_gap(spark):
    vals = [10.0] * 10 + [11.0] * 9 + [200.0]
    f = series(spark, vals).filter(F.col("date") != D(2025, 1, 5))
    out = J.daily_anomalies(f).collect()
    types = sorted(r.type for r in out)
    assert types == ["missing_period", "sales_spike"]
    spike = [r for r in out if r.type == "sales_spike"][0]
    assert spike.severity == "high" and spike.date == D(2025, 1, 20)
