"""Steps whose work or memory must not grow faster than the table."""

import datetime
import math

import numpy as np
import pytest

from tillsight.functions import core
from tillsight.functions.core import ORG
from tillsight.operators import dashboards as D
from tillsight.operators import features as E
from tillsight.operators import linear as L
from tillsight.operators import registry as R
from tillsight.operators import trees as TR

SERIES = [ORG, "item_id", "store_id"]
DAY = datetime.date(2000, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_correlation_in_one_pass_is_that_of_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        y, t = float(rng.integers(0, 9)), ("A", "B", None)[i % 3]
        rows.append((t, None if i % 17 == 0 else y, 1e6 + y + float(rng.normal()), None if i % 5 else -y + float(rng.normal()), 0.1,
                     float("nan") if i == 7 else y, None))
    names = ["x", "gaps", "same", "odd", "none"]
    df = spark.createDataFrame(rows, f"{ORG} string, sales double, " + ", ".join(f"{n} double" for n in names)).repartition(7)
    for digits in (None, 1):
        out = D.target_correlation(df, names, digits=digits)
        assert "MapInArrow" in _plan(out)  # no aggregate of six buffers for each feature
        got = {(r[ORG], r["feature"]): r["corr"] for r in out.collect()}
        assert len(got) == 15
        away = lambda v: v if digits is None else math.copysign(math.floor(abs(v) * 10 + 0.5), v) / 10
        for t in ("A", "B", None):
            assert got[t, "same"] is None and got[t, "none"] is None
            assert (got[t, "odd"] is None) == (t == "B")  # row 7
            for j, n in ((2, "x"), (3, "gaps")):
                both = np.array([(away(r[j]), away(r[1])) for r in rows if r[0] == t and r[1] is not None and r[j] is not None])
                assert got[t, n] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)


def test_series_windows_take_more_parts_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(core, "PART_ROWS", 10)
    rows = [("A", f"i{s}", "s", DAY + datetime.timedelta(days=d), float(s + d), 1.0) for s in range(40) for d in range(5)]
    df = spark.createDataFrame(rows, f"{ORG} string, item_id string, store_id string, date date, sales double, sell_price double")
    for step in (E.lag_features, E.rolling_features, E.price_features):
        assert "REPARTITION_BY_NUM" in _plan(step(df)) and step(df).count() == 200
    lag = {(r["item_id"], r["date"]): r["sales_lag_1"] for r in E.lag_features(df).collect()}
    assert all(lag[i, d] == (None if d == DAY else float(int(i[1:]) + (d - DAY).days - 1)) for i, d in lag)
    monkeypatch.setattr(core, "PART_ROWS", 1000)
    assert "REPARTITION_BY_NUM" not in _plan(E.lag_features(df))


def test_features_of_a_day_are_not_stored_with_every_row(spark):
    rows = [("A", f"i{s}", "s", "c", DAY + datetime.timedelta(days=d), float(s + d), 1.0 + s) for s in range(3) for d in range(40)]
    df = spark.createDataFrame(rows, f"{ORG} string, item_id string, store_id string, category string, date date, sales double, sell_price double")
    whole, stored = E.all_features(df), E.all_features(df, stored=True)
    assert whole.columns == stored.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, stored.collect()))
    widths = {f.rsplit("/", 2)[-2].split("-")[0]: len(spark.read.parquet(f).columns) for f in stored.inputFiles()}
    assert widths["series"] < len(stored.columns) - 40  # the days' features lie beside it
    from tillsight.plans import models as P
    monkey, P.sales_fact = P.sales_fact, lambda spark, sf: df
    try:
        assert any("/series-features-" in f for f in P._features(spark, "").inputFiles())
    finally:
        P.sales_fact = monkey


def test_linear_attributions_are_whole_batches(spark):
    rows = [(t, f"i{s}", "s", DAY + datetime.timedelta(days=d), float(s * d % 7 + (t == "B")), float(d), None if d % 9 == 0 else float(s)) for t in "AB" for s in range(4) for d in range(30)]
    df = spark.createDataFrame(rows, f"{ORG} string, item_id string, store_id string, date date, sales double, a double, b double")
    models = L.demand_models(df, ["a", "b"])
    attr = L.demand_attributions(models, df, ["a", "b"], [*SERIES, "date"])
    top = TR.ranked_attributions(attr, ["a", "b"], 2)
    assert "lambda" not in _plan(attr) and "avg(" not in _plan(top)
    m = {r[ORG]: r for r in models.collect()}
    for r in attr.collect():
        parts = (np.array(r["feature_values"]) - m[r[ORG]]["mean"]) * m[r[ORG]]["coef"]
        assert np.allclose(parts, r["attributions"]) and r["prediction"] == pytest.approx(r["base_value"] + parts.sum())
    got = {(r[ORG], r["feature"]): r["mean_abs_attribution"] for r in top.collect()}
    for t in "AB":
        x = np.array([[r[5], r[6] or 0.0] for r in rows if r[0] == t])
        assert [got[t, f] for f in "ab"] == pytest.approx(np.abs((x - m[t]["mean"]) * m[t]["coef"]).mean(0))


def test_only_the_days_of_forecasts_meet_them(spark):
    act = spark.createDataFrame([(t, "i", "s", DAY + datetime.timedelta(days=d), 1.0) for t in "AB" for d in range(100)],
                                f"{ORG} string, item_id string, store_id string, date date, sales double")
    due = spark.createDataFrame([("A", DAY + datetime.timedelta(days=d)) for d in (3, 3, 5)], f"{ORG} string, forecast_date date")
    assert sorted((r[ORG], r["date"].day) for r in R.actuals_on(act, due, "forecast_date").collect()) == [("A", 4), ("A", 6)]
