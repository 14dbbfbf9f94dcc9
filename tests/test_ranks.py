"""Exact quantiles, split ranks and rolling features on values made to be hard."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillsight.functions.core import exact_quantiles, ordered_image, split_rank
from tillsight.operators import features as E
from tillsight.sources import ingest as I

QS = {"lo": 0.0, "q1": 0.25, "med": 0.5, "q99": 0.99, "hi": 1.0}


def test_quantiles_of_skewed_values(spark):
    rng = np.random.default_rng(2)
    groups = {
        "outlier": np.concatenate([rng.normal(10, 3, 20_000), [1e7]]),
        "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 500), -10.0 ** rng.uniform(-300, 300, 500), [0.0, -0.0, 5e-324, -5e-324]]),
        "ties": np.repeat([3.0, 3.5, -2.0], [4000, 1, 4000]), "one": np.array([7.25]), "close": 1.0 + np.arange(3000) * 2.0 ** -52, "negative": -rng.random(777),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("one", None)]
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", QS).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        for name, q in QS.items():
            assert getattr(got[g], name) == pytest.approx(float(np.quantile(v, q)), rel=1e-12, abs=0), (g, name)


def test_images_keep_the_order(spark):
    values = sorted([float("-inf"), -1e308, -2.0, -1.0, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.5, 1e308, float("inf")])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", ordered_image(F.col("x")).alias("image")).orderBy("image").collect()
    assert [r.i for r in rows] == list(range(len(values))) and len({r.image for r in rows}) == len(values)


def test_split_ranks_are_row_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(("hot" if i % 3 else f"t{i % 7}") if i % 50 else None, int(rng.integers(0, 40)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(4)
    got = split_rank(df, ["k"], [F.desc("v"), "i"])
    assert got.columns == ["k", "v", "i", "rank"]
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "i")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    whole = split_rank(df, [], ["v", "i"]).collect()
    assert [r.i for r in sorted(whole, key=lambda r: r.rank)] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert split_rank(df.where("false"), ["k"], ["i"]).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partitionBy" not in plan and all("_part" in w for w in plan.split("Window [row_number()")[1:2])


def test_ids_by_frequency(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,), ("a",), ("b",)], "x string")
    got = {(r.x, r.x_idx) for r in I.encode_ids(df, ["x"]).collect()}
    assert got == {("b", 0.0), ("a", 1.0), ("c", 2.0), (None, 3.0)}


def test_rolling_features_are_those_of_pandas(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in range(6):
        y = 1e6 + rng.normal(size=75) if s == 1 else np.full(75, 0.1) if s == 2 else rng.integers(0, 50, 75).astype(float)
        rows += [("o", f"i{s}", "s", dt.date(2024, 1, 1) + dt.timedelta(days=d), None if s == 3 and d in (0, 1, 30) else float(y[d])) for d in range(75 if s else 1)]
    df = spark.createDataFrame(rows, "organization_id string, item_id string, store_id string, date date, sales double")
    got = E.rolling_features(df, windows=(1, 2, 5, 7, 14, 28, 30)).toPandas().sort_values(["item_id", "date"])
    assert list(got.columns[:5]) == ["organization_id", "item_id", "store_id", "date", "sales"] and len(got.columns) == 5 + 7 * 4
    for _, g in got.groupby("item_id"):
        y = pd.Series(g["sales"].to_numpy(float))
        for n in (1, 2, 5, 7, 14, 28, 30):
            r = y.rolling(n, min_periods=1)
            for k, want in (("mean", r.mean()), ("max", r.max()), ("min", r.min()), ("std", r.std())):
                have = g[f"sales_rolling_{k}_{n}"].to_numpy(float)
                assert np.allclose(have, want, rtol=1e-9, atol=1e-6, equal_nan=True), (k, n)
    assert (got[got.item_id == "i2"]["sales_rolling_std_7"].dropna() == 0).all()
    plan = E.rolling_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -27, currentrow" not in plan and plan.count("Exchange hashpartitioning") == 1
