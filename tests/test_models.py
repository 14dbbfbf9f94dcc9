"""Tree, linear and additive models against brute force."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillsight.operators import linear as L
from tillsight.operators import models as G
from tillsight.operators import trees as TR
from tillsight.operators.features import SERIES

SMALL = {"random_forest": dict(kind="forest", trees=23, depth=4, seed=42),
         "xgboost": dict(kind="levels", trees=12, depth=4, rate=0.3, ridge=1.0, least_rows=1),
         "lightgbm": dict(kind="leaves", trees=12, depth=4, rate=0.3, ridge=0.0, least_rows=5, leaves=7)}


# ------------------------------------------------------------------ splits

def binned(x, bins=TR.BINS):
    edges = [TR.edges_of(c) for c in x.T]
    return TR.Binned(TR.coded(x, edges), edges, bins)


def brute_tree(x, y, w, depth, ridge, least, factor):
    """Nested (feature, threshold, left, right) or leaf value, by trying every split between two values of a column."""
    noise = 1e-9 * float((w * y * y).sum())
    values = [np.unique(c) for c in x.T]

    def rec(rows, level):
        g, h = (w * y)[rows].sum(), w[rows].sum()
        tried = []
        for j, v in enumerate(values if level < depth else []):
            for t in (v[:-1] + v[1:]) / 2:
                a, b = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                ha, hb = w[a].sum(), w[b].sum()
                if ha >= least and hb >= least:
                    gain = (w * y)[a].sum() ** 2 / (ha + ridge) + (w * y)[b].sum() ** 2 / (hb + ridge) - g * g / (h + ridge)
                    tried.append((gain, j, t, a, b))
        most = max((c[0] for c in tried), default=0)
        if most <= noise:
            return round(factor * g / (h + ridge), 9)
        _, j, t, a, b = next(c for c in tried if c[0] >= most - most * 1e-9)
        return j, round(float(t), 9), rec(a, level + 1), rec(b, level + 1)

    return rec(np.flatnonzero(w), 0)


def nested(tree, n=0):
    if tree["feature"][n] < 0:
        return round(float(tree["value"][n]), 9)
    return (int(tree["feature"][n]), round(float(tree["threshold"][n]), 9), nested(tree, tree["left"][n]), nested(tree, tree["right"][n]))


@pytest.mark.parametrize("seed", range(8))
def test_splits_are_brute_force(seed):
    r = np.random.default_rng(seed)
    n = 60
    x = np.concatenate([r.normal(size=(n, 2)), r.integers(0, 4, (n, 2)), np.zeros((n, 1))], 1)
    y = np.round(x[:, 0] * 3 + x[:, 2] + r.normal(size=n), 2)
    data = binned(x)
    w = r.integers(0, 3, n).astype(float)
    rows = np.flatnonzero(w)
    forest, node = TR.grow_levels(data, rows, (w * y)[rows], w[rows], 4, 0.0, 1.0, 1.0)
    assert nested(forest) == brute_tree(x, y, w, 4, 0.0, 1.0, 1.0)
    for i, v in zip(rows, forest["value"][node]):  # the node of a row is the one its values lead to
        n_ = 0
        while forest["feature"][n_] >= 0:
            n_ = forest["left" if x[i, forest["feature"][n_]] <= forest["threshold"][n_] else "right"][n_]
        assert v == forest["value"][n_]
    rest = y - y.mean()
    boosted, _ = TR.grow_levels(data, np.arange(n), rest, None, 4, 1.0, 1, 0.1)
    assert nested(boosted) == brute_tree(x, rest, np.ones(n), 4, 1.0, 1, 0.1)
    leafwise, _ = TR.grow_leaves(data, rest, 4, 1.0, 1, 10 ** 6, 0.1)
    assert nested(leafwise) == nested(boosted)  # without a limit on leaves both orders give one tree
    few, _ = TR.grow_leaves(data, rest, 4, 0.0, 5, 4, 0.1)
    assert (few["feature"] < 0).sum() <= 4 and few["cover"][few["feature"] < 0].min() >= 5


def test_leaf_wise_takes_the_largest_gain_first():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3))
    y = np.where(x[:, 0] > 1.2, 50 * (x[:, 1] > 0) + 20 * (x[:, 2] > 0), x[:, 1])  # nearly all to gain is in a small corner
    y -= y.mean()
    data = binned(x)
    tree, node = TR.grow_leaves(data, y, 8, 0.0, 5, 5, 1.0)
    level, at = TR.grow_levels(data, np.arange(400), y, None, 2, 0.0, 5, 1.0)
    assert ((tree["value"][node] - y) ** 2).sum() < ((level["value"][at] - y) ** 2).sum()
    depth = {0: 0}
    for n, f in enumerate(tree["feature"]):
        if f >= 0:
            depth[tree["left"][n]] = depth[tree["right"][n]] = depth[n] + 1
    assert max(depth.values()) > 2


def test_bins_of_many_values_are_quantiles():
    x = np.random.default_rng(0).normal(size=10_000) ** 3
    edges = TR.edges_of(x, 64)
    assert len(edges) < 64 and (np.diff(edges) > 0).all()
    assert np.bincount(np.searchsorted(edges, x)).max() < 3 * 10_000 / 64
    assert TR.edges_of(np.array([1.0, 1.0])).size == 0
    data = binned(x[:, None], 16)
    assert data.total <= 16 and np.bincount(data.codes[:, 0]).max() < 2 * 10_000 / 16
    assert (np.searchsorted(data.edges[0], x, side="left") == data.codes[:, 0]).all()
    tight = np.array([1.0, np.nextafter(1.0, 2)])
    assert (tight <= TR.edges_of(tight)[0]).tolist() == [True, False]


# --------------------------------------------------------------- whole fits

def frame(spark, tenants=(("A", 900, 3.0), ("B", 300, -2.0)), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for o, n, up in tenants:
        for i in range(n):
            a, b = float(rng.normal()), float(rng.integers(0, 3))
            rows.append((o, f"I{i % 5}", f"S{i % 2}", dt.date(2024, 1, 1) + dt.timedelta(days=i), a, b, None if i % 50 == 7 else 1.0, 5.0, 10 + up * a + b * b + float(rng.normal()) / 10))
    return spark.createDataFrame(rows, "organization_id string, item_id string, store_id string, date date, a double, b double, gap double, same double, sales double")


def test_models_of_all_tenants_in_one_table(spark):
    df = frame(spark)
    got = {(r.organization_id, r.model): r for r in G.compare_models(df, specs=SMALL).collect()}
    assert set(got) == {(o, m) for o in "AB" for m in ("baseline", *SMALL)}
    assert all(r.error is None and r.points > 30 for r in got.values())
    assert all(not got[o, "baseline"].is_best for o in "AB") and sum(r.is_best for r in got.values()) == 2
    for (o, m), r in got.items():
        if m != "baseline":
            assert r.mae < got[o, "baseline"].mae / 2 and r.train_mae < 1.5 * r.mae
    again = {(r.organization_id, r.model): r.mae for r in G.compare_models(df.repartition(7), specs=SMALL).collect()}
    assert all(abs(again[k] - r.mae) < 1e-9 for k, r in got.items())
    none = G.compare_models(df.where("organization_id = 'A'").withColumn("sales", F.lit(None).cast("double")), specs=SMALL).collect()
    assert len(none) == 4 and all(r.mae is None and r.error and not r.is_best for r in none)


def test_models_are_compared_per_tenant(spark):
    rows = [(o, "i", str(k % 3), dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k % 2), s)
            for o, n, up in (("A", 300, 100.0), ("B", 60, -100.0)) for k in range(n) for s in (200 + up * (k % 2),)]
    df = spark.createDataFrame(rows, "organization_id string, item_id string, store_id string, date date, x double, sales double")
    got = G.compare_models(df, ("baseline", "random_forest"), specs={"random_forest": dict(kind="forest", trees=5, depth=2, seed=1)}).collect()
    assert sorted((r.organization_id, r.model) for r in got) == [(o, m) for o in "AB" for m in ("baseline", "random_forest")]
    assert {(r.organization_id, r.model) for r in got if r.is_best} == {("A", "random_forest"), ("B", "random_forest")}
    assert all(r.mae < 1 for r in got if r.model == "random_forest")  # a forest over both tenants misses B's sales by far


def test_scores_are_those_of_the_tree_arrays(spark):
    df = frame(spark)
    fits, rows, features = G.fitted(df, specs=SMALL)
    assert features == ["a", "b", "gap", "same"] and rows.columns[:4] == SERIES + ["date"]
    models = {}
    for r in fits.collect():
        assert r.features == ["a", "b", "gap"]  # a column without two values is left out; NULL counts as 0
        models.setdefault((r.organization_id, r.model), []).append(r)
    assert {k: len(v) for k, v in models.items()} == {(o, m): s["trees"] for o in "AB" for m, s in SMALL.items()}
    data = {(r.organization_id, r.date): r for r in rows.collect()}
    scored = TR.score(rows, fits, features, SERIES + ["date"], chunk=100).collect()
    assert len(scored) == 3 * len(data)
    for s in scored[::7]:
        row, total = data[s.organization_id, s.date], 0.0
        for t in models[s.organization_id, s.model]:
            n = 0
            while t.feature[n] >= 0:
                v = row[t.features[t.feature[n]]] or 0.0
                n = t.left[n] if v <= t.threshold[n] else t.right[n]
            total += t.value[n]
        assert s.pred == pytest.approx(max(0.0, t.base + total), abs=1e-9)


def test_importances_sum_to_one(spark):
    fits, _, _ = G.fitted(frame(spark), specs=SMALL)
    imp = TR.importance(fits).collect()
    for o in "AB":
        for m in SMALL:
            mine = {r.feature: r.importance for r in imp if (r.organization_id, r.model) == (o, m)}
            assert set(mine) == {"a", "b", "gap"} and sum(mine.values()) == pytest.approx(1)
            gains, each = {}, []
            for t in fits.where(f"organization_id = '{o}' and model = '{m}'").collect():
                tree = {}
                for f, g in zip(t.feature, t.gain):
                    if f >= 0:
                        tree[t.features[f]] = tree.get(t.features[f], 0) + g
                each.append(tree)
            for tree in each:
                for f, g in tree.items():
                    gains[f] = gains.get(f, 0) + (g / sum(tree.values()) if m == "random_forest" else g)
            assert all(mine[f] == pytest.approx(g / sum(gains.values())) for f, g in gains.items())


# ------------------------------------------------------------- attribution

def expectation(tree, x, known, n=0):
    f = tree["feature"][n]
    if f < 0:
        return tree["value"][n]
    a, b = tree["left"][n], tree["right"][n]
    if f in known:
        return expectation(tree, x, known, a if x[f] <= tree["threshold"][n] else b)
    return (tree["cover"][a] * expectation(tree, x, known, a) + tree["cover"][b] * expectation(tree, x, known, b)) / tree["cover"][n]


def test_tree_attribution_is_subset_enumeration():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6))
    x[:, 3] = rng.integers(0, 3, 300)
    y = x[:, 0] * x[:, 1] + x[:, 3] * x[:, 2]
    data = binned(x)
    tree, _ = TR.grow_levels(data, np.arange(300), y, None, 6, 0.0, 1, 1.0)
    phi, expected = TR.tree_shapley(tree, x[:5], np.arange(6))
    for row in range(5):
        for j in range(6):
            others = [i for i in range(6) if i != j]
            want = sum(math.factorial(k) * math.factorial(5 - k) / math.factorial(6)
                       * (expectation(tree, x[row], {*s, j}) - expectation(tree, x[row], set(s))) for k in range(6) for s in combinations(others, k))
            assert phi[row, j] == pytest.approx(want, abs=1e-9)
        assert expected + phi[row].sum() == pytest.approx(expectation(tree, x[row], set(range(6))), abs=1e-9)


def test_attributions_add_up_and_rank(spark):
    df = frame(spark)
    fits, rows, features = G.fitted(df, specs=SMALL)
    attr = TR.attributions(fits, rows, features, SERIES + ["date"], chunk=150)
    got = attr.collect()
    assert len(got) == 3 * rows.count()
    pred = {(r.organization_id, r.date, r.model): r.pred for r in TR.score(rows, fits, features, SERIES + ["date"]).collect()}
    for r in got:
        assert r.base_value + sum(r.attributions) == pytest.approx(r.prediction, abs=1e-6)
        assert max(r.prediction, 0) == pytest.approx(pred[r.organization_id, r.date, r.model], abs=1e-9)
        assert r.attributions[3] == 0.0  # the column without two values
    ranked = TR.ranked_attributions(attr, features, 2).collect()
    mine = sorted((r.rank, r.feature, r.mean_abs_attribution) for r in ranked if (r.organization_id, r.model) == ("A", "xgboost"))
    mean = np.abs([r.attributions for r in got if (r.organization_id, r.model) == ("A", "xgboost")]).mean(0)
    assert [(k, f) for k, f, _ in mine] == [(1, "a"), (2, "b")] and mine[0][2] == pytest.approx(mean[0])
    dep = [r for r in TR.attribution_dependence(attr, features, "a", 10).collect() if (r.organization_id, r.model) == ("A", "random_forest")]
    assert sum(r.n for r in dep) == sum(1 for r in got if (r.organization_id, r.model) == ("A", "random_forest"))
    dep.sort(key=lambda r: r.bucket)
    assert dep[0].mean_attribution < 0 < dep[-1].mean_attribution  # sales rise with a
    flat = TR.attribution_dependence(attr, features, "same").collect()
    assert all(r.bucket == 0 and r.mean_attribution == 0 for r in flat)


def test_permutation_importance(spark):
    df = frame(spark).withColumn("noise", F.col("a") * 0 + F.rand(3))
    fits, rows, features = G.fitted(df, ["random_forest"], specs={"random_forest": dict(SMALL["random_forest"], depth=1)})
    test = rows.where("_test")
    got = {(r.organization_id, r.feature): r.importance for r in TR.permutation_importance(fits, test, features, SERIES + ["date"], chunk=40).collect()}
    again = {(r.organization_id, r.feature): r.importance for r in TR.permutation_importance(fits, test.repartition(5), features, SERIES + ["date"], chunk=77).collect()}
    assert got.keys() == again.keys() == {(o, f) for o in "AB" for f in features}
    assert all(again[k] == pytest.approx(v, abs=1e-9) for k, v in got.items())
    for o in "AB":
        used = {r.features[f] for r in fits.where(f"organization_id = '{o}'").collect() for f in r.feature if f >= 0}
        assert all(got[o, f] == 0.0 for f in features if f not in used) and "same" not in used
        assert max((got[o, f], f) for f in features)[1] in ("a", "b")
    # the permutation itself: every row gets another row's value, each value is given once
    one = test.where("organization_id = 'A'").orderBy(F.xxhash64(F.lit(42), *SERIES, "date"), *SERIES, "date").collect()
    forest = [r for r in fits.collect() if r.organization_id == "A"]

    def predict(row, j, value):
        total = 0.0
        for t in forest:
            n = 0
            while t.feature[n] >= 0:
                f = t.features[t.feature[n]]
                n = t.left[n] if (value if f == j else row[f] or 0.0) <= t.threshold[n] else t.right[n]
            total += t.value[n]
        return max(0.0, total)

    hashes = spark.range(len(features)).select(F.xxhash64(F.lit(42), F.col("id").cast("int")).alias("h")).collect()
    for k, j in enumerate(features):
        shift = hashes[k].h % (len(one) - 1) + 1
        grown = [abs(predict(r, j, one[(i + shift) % len(one)][j] or 0.0) - r.sales) - abs(predict(r, j, r[j] or 0.0) - r.sales) for i, r in enumerate(one)]
        assert got["A", j] == pytest.approx(sum(grown) / len(one), abs=1e-9)


# -------------------------------------------------------------- forecasts

def test_recursive_forecast_is_a_day_by_day_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(50):
        days = int(rng.choice([1, 2, 6, 20, 40]))
        for d in range(days):
            rows.append((("A", "B")[s % 2], f"I{s}", "S", dt.date(2024, 3, 1) + dt.timedelta(days=d), float(rng.integers(0, 30)) + (s % 5)))
    df = spark.createDataFrame(rows, "organization_id string, item_id string, store_id string, date date, sales double")
    from tillsight.operators import features as E
    full = E.time_features(E.rolling_features(E.lag_features(df)))
    fits, _, features = G.fitted(full, ["random_forest"], specs=SMALL)
    got = {(r.item_id, r.date): r.predicted_sales for r in TR.forecast_recursive(fits, full, features, 9, chunk=7).collect()}
    assert len(got) == 50 * 9
    forests = {}
    for r in fits.collect():
        forests.setdefault(r.organization_id, []).append(r)
    last = {}
    for r in sorted(full.collect(), key=lambda r: r.date):
        last[r.item_id] = r
    origin = {o: max(r[3] for r in rows if r[0] == o) for o in "AB"}
    for item, row in last.items():
        history = [r[4] for r in rows if r[1] == item]
        values = {f: row[f] or 0.0 for f in features}
        for h in range(1, 10):
            day = origin[row.organization_id] + dt.timedelta(days=h)
            known = pd.Series(history)
            for n in (1, 7, 14, 28):
                values[f"sales_lag_{n}"] = history[-n] if n <= len(history) else 0.0
            for n in (7, 14, 28):
                tail = known.tail(n)
                values[f"sales_rolling_mean_{n}"], values[f"sales_rolling_max_{n}"], values[f"sales_rolling_min_{n}"] = tail.mean(), tail.max(), tail.min()
                values[f"sales_rolling_std_{n}"] = tail.std() if len(tail) > 1 else 0.0
            values |= {"year": day.year, "month": day.month, "day": day.day, "dayofweek": day.weekday(), "quarter": (day.month + 2) // 3, "is_weekend": int(day.weekday() >= 5)}
            total = 0.0
            for t in forests[row.organization_id]:
                n = 0
                while t.feature[n] >= 0:
                    n = t.left[n] if values[t.features[t.feature[n]]] <= t.threshold[n] else t.right[n]
                total += t.value[n]
            assert got[item, day] == pytest.approx(max(total, 0.0), abs=1e-9)
            history.append(max(total, 0.0))


# ------------------------------------------------------------ linear models

def test_demand_model_is_least_squares(spark):
    df = frame(spark).withColumn("twice", 2 * F.col("a"))  # collinear
    features = ["a", "b", "twice", "same"]
    models = {r.organization_id: r for r in L.demand_models(df, features).collect()}
    attr = L.demand_attributions(L.demand_models(df, features), df, features, SERIES + ["date"]).collect()
    for o in "AB":
        rows = [r for r in df.collect() if r.organization_id == o]
        x = np.array([[r.a, r.b, 2 * r.a, 5.0] for r in rows])
        y = np.array([r.sales for r in rows])
        fit = np.column_stack([np.ones(len(x)), x]) @ np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
        m = models[o]
        assert np.abs(m.intercept + x @ np.array(m.coef) - fit).max() < 1e-8
        for r in [r for r in attr if r.organization_id == o]:
            assert r.base_value + sum(r.attributions) == pytest.approx(r.prediction, abs=1e-9) and r.base_value == pytest.approx(y.mean())


def test_additive_model_is_ridge_regression_and_its_sums_merge(spark):
    rng = np.random.default_rng(1)
    rows = [(o, dt.date(2023, 1, 1) + dt.timedelta(days=d), float(50 + d / 10 * (d < n // 2) + 10 * math.sin(2 * math.pi * d / 7) + rng.normal()))
            for o, n in (("A", 500), ("B", 90)) for d in range(n)] + [("C", dt.date(2023, 1, 1), 4.0)]
    df = spark.createDataFrame(rows, "organization_id string, date date, sales double")
    heads = L.additive_headers(df)
    whole = {(r.organization_id, r.i): r.s for r in L.additive_sums(df, heads).collect()}
    parts = [L.additive_sums(df.where(c), heads) for c in ("date < '2023-03-31'", "date >= '2023-03-31'")]
    merged = {(r.organization_id, r.i): r.s for r in L.merge_sums(*parts, L.WIDTH + 1).collect()}
    assert whole.keys() == merged.keys() and all(np.allclose(merged[k], s, rtol=1e-12, atol=1e-9) for k, s in whole.items())
    got = {(r.organization_id, r.date): r for r in L.additive_forecast(df, 5).collect()}
    assert len(got) == len(rows) + 15
    for o, n in (("A", 500), ("B", 90)):
        days = np.arange(n + 5)
        t = days / (n - 1)
        epoch = days + (dt.date(2023, 1, 1) - dt.date(1970, 1, 1)).days
        x = np.column_stack([np.ones(n + 5), t] + [np.maximum(t - 0.8 * (i + 1) / 26, 0) for i in range(25)]
                            + [f(2 * np.pi * k * epoch / p) for p, m in ((365.25, 10), (7.0, 3)) for k in range(1, m + 1) for f in (np.sin, np.cos)])
        y = np.array([r[2] for r in rows if r[0] == o])
        scale = np.abs(y).max()
        root = np.sqrt(np.array([0.0] * 2 + [1.0] * 25 + [0.01] * 26))
        coef = np.linalg.lstsq(np.vstack([x[:n], np.diag(root)]), np.concatenate([y / scale, np.zeros(53)]), rcond=None)[0]
        fit = x @ coef * scale
        band = 1.96 * math.sqrt(np.mean((fit[:n] - y) ** 2))
        for d in range(n + 5):
            r = got[o, dt.date(2023, 1, 1) + dt.timedelta(days=d)]
            assert r.yhat == pytest.approx(fit[d], abs=1e-5) and r.yhat_upper - r.yhat == pytest.approx(band, abs=1e-4)
            assert (r.y is None) == (d >= n)
    score = {r.organization_id: r for r in L.additive_metrics(L.additive_forecast(df, 5)).collect()}
    assert score["A"].points == 29 and score["C"].points == 1
