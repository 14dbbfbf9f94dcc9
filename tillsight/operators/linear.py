"""Linear models of all tenants from mergeable normal equations (G05, C14, G16 for linear models).

A tenant's model is a function of its cross sums: for row vectors v (a constant, the inputs, the
target) the entries of sum(v v'). Cross sums are a table of (tenant, i, sums of v_i * v), added up
in the tasks that hold the rows and then by key, so they merge: the sums of new days
are added to those stored (``merge_sums``) and no old day is read again. Only the sums, one small
matrix per tenant, are solved.

* ``demand_models``: least squares on standardised features, the shortest solution where features
  are collinear, and its exact attributions coef * (x - mean).
* ``additive_*``: the additive forecast of a tenant's daily totals: a trend whose slope may change at 25 dates
  (hinge columns), yearly and weekly Fourier terms, a ridge on slope changes and seasons, and a 95 % band from the
  residuals. An approximation of the reference's additive model, whose library is not available.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions.core import ORG, checked_broadcast
from tillsight.operators.trees import feature_array, value_matrix

SUMS = f"{ORG} string, i int, s array<double>"


def cross_sums(rows: DataFrame, vector: Column, width: int) -> DataFrame:
    """``SUMS``: for each tenant and position i the sums of v_i * v over its rows."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        held = {}
        for batch in batches:
            v = value_matrix(batch.column(1), width)
            codes = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            which = codes.indices.to_numpy(zero_copy_only=False)
            for k, tenant in enumerate(codes.dictionary.to_pylist()):
                part = v[which == k]
                held[tenant] = held.get(tenant, 0.0) + part.T @ part
        if held:
            yield pa.RecordBatch.from_arrays([
                pa.array([t for t in held for _ in range(width)], pa.string()), pa.array([i for _ in held for i in range(width)], pa.int32()),
                pa.array([row for m in held.values() for row in m], pa.list_(pa.float64()))], names=[ORG, "i", "s"])

    parts = rows.select(ORG, vector.alias("_v")).mapInArrow(run, SUMS)
    return _added(parts, width)


def _added(parts: DataFrame, width: int) -> DataFrame:
    each = parts.groupBy(ORG, "i").agg(*[F.sum(F.col("s")[j]).alias(f"_{j}") for j in range(width)])
    return each.select(ORG, "i", F.array(*[F.col(f"_{j}") for j in range(width)]).alias("s"))


def merge_sums(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Cross sums of two disjoint sets of rows, together."""
    return _added(a.unionByName(b), width)


def _solved(sums: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(matrix) -> dict`` of each tenant's cross sums (one small matrix)."""
    def run(key, table):
        import pyarrow as pa
        order = np.argsort(table.column("i").to_numpy())
        matrix = np.array(table.column("s").to_pylist())[order]
        out = {ORG: key[0].as_py(), **solve(matrix)}
        kinds = {"double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
        return pa.table({n: pa.array([out[n]], kinds[k]) for n, k in (f.split() for f in schema.split(", "))})

    return sums.groupBy(ORG).applyInArrow(run, schema)


# ------------------------------------------------------------- demand model

DEMAND = f"{ORG} string, intercept double, mean array<double>, coef array<double>"


def demand_models(rows: DataFrame, features: list[str], target: str = "sales") -> DataFrame:
    """Least squares of ``target`` on ``features`` (NULL as 0) for each tenant."""
    p = len(features)
    v = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in [*features, target]])
    sums = cross_sums(rows.where(F.col(target).isNotNull()), v, p + 2)

    def solve(m):
        n = m[0, 0]
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        size = np.sqrt(np.maximum(np.diag(cov)[:p], 0.0))
        live = size > 1e-9 * (1 + np.abs(mean[:p]))
        unit = np.where(live, size, 1.0)
        gram, side = cov[:p, :p] / np.outer(unit, unit) * np.outer(live, live), cov[:p, p] / unit * live
        values, vectors = np.linalg.eigh(gram)
        use = values > 1e-9 * max(values.max(initial=0.0), 1e-300)
        beta = vectors[:, use] @ ((vectors[:, use].T @ side) / values[use]) / unit * live
        return {"intercept": float(mean[p] - beta @ mean[:p]), "mean": mean[:p].tolist(), "coef": beta.tolist()}

    return _solved(sums, solve, DEMAND)


def demand_attributions(models: DataFrame, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """G16 for linear models, in the form of ``trees.attributions``: exact additive parts coef * (x - mean). Rows meet
    their tenant's model by a broadcast; the parts of a batch are one matrix product in the task that holds it."""
    width, columns = len(features), list(dict.fromkeys([ORG, *keys]))
    joined = rows.select(*columns, feature_array(features).alias("_x")).join(checked_broadcast(models), ORG)
    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "model string, prediction double, base_value double, feature_values array<double>, attributions array<double>"])

    def run(batches):
        import pyarrow as pa
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, width, dtype=np.int32)), pa.array(m.ravel()))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, mean, coef = (value_matrix(batch.column(c), width) for c in ("_x", "mean", "coef"))
            base = batch.column("intercept").to_numpy(zero_copy_only=False) + (mean * coef).sum(1)
            parts = (x - mean) * coef
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(["linear"] * len(x), pa.string()), pa.array(base + parts.sum(1)), pa.array(base), lists(x), lists(parts)],
                names=[*keys, "model", "prediction", "base_value", "feature_values", "attributions"])

    return joined.select(*columns, "_x", "intercept", "mean", "coef").mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# ----------------------------------------------------------- additive model

CHANGES, CHANGE_SHARE = 25, 0.8  # dates at which the slope may change, in the first part of the history
YEARLY, WEEKLY = 10, 3           # pairs of Fourier terms
WIDTH = 2 + CHANGES + 2 * (YEARLY + WEEKLY)
HINGE_RIDGE, WAVE_RIDGE = 1.0, 0.01


def additive_headers(daily: DataFrame, target: str = "sales") -> DataFrame:
    """One row per tenant: the first day, the days spanned and the largest total, which fix the design: days added later
    use the same header, so that their cross sums can be added."""
    return daily.where(F.col(target).isNotNull()).groupBy(ORG).agg(
        F.min("date").alias("first"), F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1)).cast("double").alias("span"),
        F.greatest(F.max(F.abs(F.col(target).cast("double"))), F.lit(1e-9)).alias("scale"))


def additive_vector(yearly: int = YEARLY, weekly: int = WEEKLY) -> Column:
    """The design of a day next to its header: 1, time, hinges, yearly and weekly terms."""
    day = F.datediff("date", F.lit("1970-01-01")).cast("double")
    t = F.datediff(F.col("date"), F.col("first")) / F.col("span")
    hinges = [F.greatest(t - CHANGE_SHARE * (i + 1) / (CHANGES + 1), F.lit(0.0)) for i in range(CHANGES)]
    waves = [f(2 * math.pi * k * day / period) for period, order in ((365.25, yearly), (7.0, weekly)) for k in range(1, order + 1) for f in (F.sin, F.cos)]
    return F.array(F.lit(1.0), t, *hinges, *waves)


def additive_sums(daily: DataFrame, headers: DataFrame, target: str = "sales", yearly: int = YEARLY, weekly: int = WEEKLY) -> DataFrame:
    """Cross sums of the days' design and their scaled totals."""
    rows = daily.where(F.col(target).isNotNull()).join(checked_broadcast(headers), ORG)
    vector = F.concat(additive_vector(yearly, weekly), F.array(F.col(target).cast("double") / F.col("scale")))
    return cross_sums(rows, vector, 3 + CHANGES + 2 * (yearly + weekly))


def additive_models(sums: DataFrame) -> DataFrame:
    """Ridge solution of each tenant's sums: coef, and sigma, the spread of the scaled residuals."""
    def solve(m):
        a, b, c = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        ridge = np.full(len(b), WAVE_RIDGE)
        ridge[:2], ridge[2:2 + CHANGES] = 0.0, HINGE_RIDGE
        coef = np.linalg.lstsq(a + np.diag(ridge), b, rcond=None)[0]
        left = max(0.0, float(c - 2 * coef @ b + coef @ a @ coef))
        return {"coef": coef.tolist(), "sigma": math.sqrt(left / m[0, 0])}

    return _solved(sums, solve, f"{ORG} string, coef array<double>, sigma double")


def additive_forecast(daily: DataFrame, horizon: int = 28, target: str = "sales", yearly_order: int = YEARLY, weekly_order: int = WEEKLY) -> DataFrame:
    """(tenant, date, y, yhat, yhat_lower, yhat_upper) for every day of the history and ``horizon`` days after
    the tenant's last date; the band is 1.96 standard deviations of the residuals."""
    headers = additive_headers(daily, target)
    models = checked_broadcast(additive_models(additive_sums(daily, headers, target, yearly_order, weekly_order)).join(headers, ORG))  # one row per tenant
    last = daily.groupBy(ORG).agg(F.max("date").alias("_last"))
    future = last.select(ORG, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))).alias("date"))
    days = daily.select(ORG, "date", F.col(target).cast("double").alias("y")).unionByName(future.withColumn("y", F.lit(None).cast("double")))
    yhat = dot(additive_vector(yearly_order, weekly_order), F.col("coef")) * F.col("scale")
    out = days.join(models, ORG).withColumn("yhat", yhat).withColumn("_band", 1.96 * F.col("sigma") * F.col("scale"))
    return out.select(ORG, "date", "y", "yhat", (F.col("yhat") - F.col("_band")).alias("yhat_lower"), (F.col("yhat") + F.col("_band")).alias("yhat_upper"))


def additive_metrics(forecast: DataFrame, days: int = 28) -> DataFrame:
    """The metrics of the fitted values on each tenant's last ``days`` days, as the reference scores this model."""
    from tillsight.operators.models import metrics
    known = forecast.where(F.col("y").isNotNull())
    cut = checked_broadcast(known.groupBy(ORG).agg(F.date_sub(F.max("date"), days).alias("_from")))  # one row per tenant
    return metrics(known.join(cut, ORG).where(F.col("date") >= F.col("_from")), [ORG], "y", "yhat")
