"""Inventory, purchase-decision and what-if operators.

Everything starts from one per-series statistics frame (count, mean,
population std, last price, last-28-row sum, stock) built by a single
``groupBy(tenant, item, store)``; the decisions are then ~20 column
expressions on that frame — no Python, no per-series loop. The what-if grid
explodes a literal array of scenario structs on each series row (a fixed,
parameter-sized fan-out, no join) and aggregates per scenario.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.core import ORG, per_tenant, round_half_away as rnd, tenant_as_of

SERIES = [ORG, "item_id", "store_id"]
NO_DEMAND_DAYS = 999.0
HORIZON_DAYS = 365


@dataclass(frozen=True)
class Policy:
    """Inventory policy parameters (defaults as in the reference)."""
    service_level: float = 0.95
    lead_time_days: int = 7
    order_cost: float = 100.0
    holding_cost_rate: float = 0.25
    unit_cost: float = 10.0
    demand_growth: float = 0.0
    name: str = field(default="baseline", compare=False)

    @property
    def z(self) -> float:
        return NormalDist().inv_cdf(self.service_level)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---------------------------------------------------------------- statistics

def series_stats(fact: DataFrame, stock: DataFrame | None = None, estimate_window: int = 28) -> DataFrame:
    """Per-series statistics shared by H06/H11/H13 and the alert detectors.

    C12: last price = the price on the series' latest date (``max_by``).
    C02/H01: stock joined from the snapshot; a tenant with no known stock at
    all gets the estimate ``max(1.5 × sum of the last 28 rows, 10)``, others
    get 0 for series without a snapshot row.
    """
    w = Window.partitionBy(*SERIES).orderBy(F.desc("date"))
    r = fact.withColumn("_rn", F.row_number().over(w))
    st = r.groupBy(*SERIES).agg(
        F.count("sales").alias("n_obs"),
        F.avg("sales").alias("mean_sales"),
        F.stddev_pop("sales").alias("std_pop"),
        F.sum("sales").alias("total_sales"),
        F.max_by("sell_price", "date").alias("last_price"),
        F.max("date").alias("last_date"),
        F.sum(F.when(F.col("_rn") <= estimate_window, F.col("sales"))).alias("recent_sum"),
    )
    estimate = F.greatest(F.col("recent_sum") * 1.5, F.lit(10.0))
    if stock is None:
        return st.withColumn("current_stock", estimate).withColumn("stock_estimated", F.lit(True))
    j = st.join(stock.select(*SERIES, "current_stock"), SERIES, "left")
    known = (j.groupBy(ORG).agg(F.max(F.col("current_stock").isNotNull()).alias("_any_stock")))
    j = j.join(per_tenant(known), ORG, "left")
    return (j.withColumn("current_stock", F.when(F.col("_any_stock"), F.coalesce("current_stock", F.lit(0.0)))
                         .otherwise(estimate))
             .withColumn("stock_estimated", ~F.col("_any_stock")).drop("_any_stock"))


def demand_terms(stats: DataFrame, policy: Policy, multiplier=1.0, growth=None) -> dict:
    """H02-H05 as column expressions (population std, 0.1 × mean fallback)."""
    m = _lit(multiplier) * (1 + _lit(policy.demand_growth if growth is None else growth))
    avg = F.col("mean_sales") * m
    sd = F.when(F.col("std_pop").isNull() | (F.col("std_pop") == 0), avg * 0.1).otherwise(F.col("std_pop"))
    return {"avg": avg, "sd": sd}


def safety_stock(z, sd, lead) -> Column:
    """``max(z · σ · √L, 0)``."""
    return F.greatest(_lit(z) * sd * F.sqrt(_lit(lead).cast("double")), F.lit(0.0))


def reorder_point(avg, ss, lead) -> Column:
    """``μ · L + SS``."""
    return avg * _lit(lead) + ss


def eoq(avg, order_cost=100.0, holding_cost_rate=0.25, unit_cost=10.0) -> Column:
    """``max(√(2·D·S / (c·h)), 1)`` with D = 365 μ; 0 when demand ≤ 0."""
    annual = avg * 365
    q = F.sqrt(2 * annual * _lit(order_cost) / (_lit(unit_cost) * _lit(holding_cost_rate)))
    return F.when(annual <= 0, F.lit(0.0)).otherwise(F.greatest(q, F.lit(1.0)))


def status_of(stock, ss, rop, q) -> Column:
    return (F.when(stock < ss, "CRITICAL").when(stock < rop, "LOW")
             .when(stock > rop + q, "EXCESS").otherwise("OK"))


# ----------------------------------------------------------------- H06-H10

def recommendations(stats: DataFrame, policy: Policy = Policy(), multiplier=1.0, as_of=None,
                    overstock_days: int = 60) -> DataFrame:
    """H06 (+H07, H08 columns; H10b: all series in one job): the inventory recommendation table per series.

    As in the reference, the lead time is always 7 days here (the request's
    lead time is not passed through) and EOQ uses default costs.
    """
    lead = 7
    t = demand_terms(stats, policy, multiplier, growth=0.0)
    avg, sd = t["avg"], t["sd"]
    ss = safety_stock(policy.z, sd, lead)
    rop = reorder_point(avg, ss, lead)
    q = eoq(avg)
    b = stats
    if "as_of" not in b.columns:
        b = b.join(per_tenant(tenant_as_of(stats.withColumnRenamed("last_date", "date"), as_of)), ORG, "left")
    b = b.select(*SERIES, "as_of", "current_stock", avg.alias("avg_daily_demand"), sd.alias("demand_std"),
                 ss.alias("safety_stock"), rop.alias("reorder_point"), q.alias("eoq"))
    stock, a = F.col("current_stock"), F.col("avg_daily_demand")
    days = F.when(a > 0, stock / a)
    stockout = F.when((a > 0) & (days < HORIZON_DAYS), days)
    return b.select(
        *SERIES, "as_of", "current_stock", "avg_daily_demand", "demand_std", "safety_stock", "reorder_point", "eoq",
        F.greatest(F.lit(0.0), F.col("reorder_point") - stock).alias("recommended_order_qty"),
        status_of(stock, F.col("safety_stock"), F.col("reorder_point"), F.col("eoq")).alias("status"),
        F.coalesce(days, F.lit(NO_DEMAND_DAYS)).alias("days_of_stock"),
        F.coalesce(rnd(stockout, 1), F.lit(NO_DEMAND_DAYS)).alias("stockout_in_days"),
        F.date_add("as_of", stockout.cast("int")).alias("stockout_date"),
        F.coalesce(days > overstock_days, F.lit(False)).alias("is_overstock"),
        F.when(days > overstock_days, F.greatest(F.lit(0.0), stock - a * overstock_days)).alias("excess_units"),
        _lit(multiplier).cast("double").alias("demand_multiplier_used"),
    )


def stockout_predictions(recs: DataFrame, within_days: float = 90) -> DataFrame:
    """Series expected to run out within ``within_days`` days."""
    a, s = F.col("avg_daily_demand"), F.col("current_stock")
    days = s / a
    return (recs.filter((a > 0) & (days < HORIZON_DAYS) & (rnd(days, 1) < within_days))
                .select(*SERIES, "current_stock", "avg_daily_demand", rnd(days, 1).alias("days_remaining"),
                        F.date_add("as_of", days.cast("int")).alias("predicted_stockout_date"),
                        (days < 7).alias("is_critical")))


def overstock_items(recs: DataFrame, threshold_days: int = 60) -> DataFrame:
    """Series whose stock covers more than ``threshold_days`` days."""
    a, s = F.col("avg_daily_demand"), F.col("current_stock")
    days = s / a
    return (recs.filter((a > 0) & (days > threshold_days))
                .select(*SERIES, "current_stock", "avg_daily_demand", rnd(days, 1).alias("days_of_stock"),
                        F.greatest(F.lit(0.0), s - a * threshold_days).alias("excess_units"),
                        F.format_string("Stock covers %d days (threshold: %d)",
                                        F.bround(rnd(days, 1), 0).cast("bigint"),
                                        F.lit(threshold_days)).alias("reason")))


def stockout_risk(recs: DataFrame, threshold_days: float = 7) -> DataFrame:
    """At-risk series (days < threshold or LOW / CRITICAL), ascending days."""
    return recs.filter((F.col("days_of_stock") < threshold_days) | F.col("status").isin("LOW", "CRITICAL"))


def excess_inventory(recs: DataFrame, excess_months: int = 2) -> DataFrame:
    """Series holding more than ``30 × excess_months`` days of stock."""
    return recs.filter(F.col("days_of_stock") > excess_months * 30)


def inventory_metrics(recs: DataFrame) -> DataFrame:
    """KPIs per tenant."""
    st = F.col("status")
    return recs.groupBy(ORG).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count(F.when(st == "OK", 1)).alias("items_ok"),
        F.count(F.when(st == "LOW", 1)).alias("items_low"),
        F.count(F.when(st == "CRITICAL", 1)).alias("items_critical"),
        F.count(F.when(st == "EXCESS", 1)).alias("items_excess"),
        F.avg("days_of_stock").alias("avg_days_of_stock"),
        F.sum("safety_stock").alias("total_safety_stock"),
        F.sum("recommended_order_qty").alias("total_recommended_orders"),
        F.count(F.when(F.col("recommended_order_qty") > 0, 1)).alias("items_need_reorder"))


# ------------------------------------------------------------------ H11-H14

def _decision_columns(p: dict, multiplier) -> list:
    """H11 columns given per-row policy columns ``p`` (service z, lead, hcr, unit cost, growth)."""
    lead = p["lead"]
    m = _lit(multiplier) * (1 + p["growth"])
    avg = F.col("mean_sales") * m
    sd = F.when(F.col("std_pop").isNull() | (F.col("std_pop") == 0), avg * 0.1).otherwise(F.col("std_pop"))
    ss = safety_stock(p["z"], sd, lead)
    rop = reorder_point(avg, ss, lead)
    q = eoq(avg)  # scenario order / unit / holding costs never reach EOQ (as in the reference)
    stock = F.col("current_stock")
    ltd = avg * lead
    qty = F.greatest(F.lit(0.0), rop + ltd - stock)
    dtr = F.when(avg > 0, (stock - rop) / avg).otherwise(F.lit(NO_DEMAND_DAYS))
    dso = F.when(avg > 0, stock / avg).otherwise(F.lit(NO_DEMAND_DAYS))
    today = dtr <= lead
    order_off = F.when(today, F.lit(0).cast("bigint")).otherwise(F.floor(dtr))
    last_off = F.datediff(F.lit("9999-12-31").cast("date"), F.col("as_of"))
    on = lambda off: F.when(off <= last_off, F.date_add("as_of", off.cast("int")))  # noqa: E731 - NULL: no such date
    arrival_off = order_off + lead
    has_so = dso < HORIZON_DAYS
    price = F.when(F.col("last_price").isNull() | (F.col("last_price") == 0), p["unit_cost"]) \
             .otherwise(F.col("last_price"))
    inv_value = stock * price
    excess = F.when(dso > 90, F.greatest(F.lit(0.0), stock - avg * 90)).otherwise(F.lit(0.0))
    capital = excess * price
    lose = has_so & (dso < arrival_off) & (avg > 0)
    gap = F.greatest(F.lit(0.0), F.floor(arrival_off - dso).cast("double"))
    loss = F.when(lose, gap * avg * price).otherwise(F.lit(0.0))
    carrying = inv_value * p["hcr"]
    turnover = F.when(stock > 0, avg * 365 / stock)
    return [
        avg.alias("avg_daily_demand"), sd.alias("demand_std"), ss.alias("safety_stock"),
        rop.alias("reorder_point"), q.alias("eoq"), qty.alias("recommended_order_qty"),
        today.alias("order_today"),
        F.when(today | (dtr < HORIZON_DAYS), on(order_off)).alias("order_date"),
        on(arrival_off).alias("arrival_date"),
        F.when(has_so, rnd(dso, 1)).alias("stockout_in_days"),
        F.when(has_so, F.date_add("as_of", F.floor(dso).cast("int"))).alias("stockout_date"),
        status_of(stock, ss, rop, q).alias("status"),
        F.when(has_so, rnd(dso, 1)).otherwise(F.lit(NO_DEMAND_DAYS)).alias("days_of_stock"),
        price.alias("unit_price"),
        rnd(inv_value, 2).alias("inventory_value"),
        rnd(excess, 1).alias("excess_units"),
        rnd(capital, 2).alias("overstock_capital"),
        rnd(loss, 2).alias("stockout_revenue_loss"),
        rnd(carrying, 2).alias("carrying_cost"),
        rnd(turnover, 2).alias("inventory_turnover"),
        rnd(dso, 1).alias("days_of_inventory"),
        rnd(capital * p["hcr"] + loss, 2).alias("potential_savings"),
    ]


def _policy_cols(policy: Policy) -> dict:
    return {"z": F.lit(policy.z), "lead": F.lit(policy.lead_time_days), "hcr": F.lit(policy.holding_cost_rate),
            "unit_cost": F.lit(policy.unit_cost), "growth": F.lit(policy.demand_growth)}


def _with_as_of(stats: DataFrame, as_of) -> DataFrame:
    if "as_of" in stats.columns:
        return stats
    return stats.join(per_tenant(tenant_as_of(stats.withColumnRenamed("last_date", "date"), as_of)), ORG, "left")


def purchase_decisions(stats: DataFrame, policy: Policy = Policy(), multiplier=1.0, as_of=None) -> DataFrame:
    """Purchase decision and its money per series."""
    b = _with_as_of(stats, as_of)
    return b.select(*SERIES, "as_of", "current_stock", *_decision_columns(_policy_cols(policy), multiplier))


def _units(c: str, digits: int):
    """Σ of a column rounded to ``digits`` decimals, as a whole number of its last
    decimal: the same in any order of summation."""
    return F.sum(F.round(F.col(c) * 10 ** digits).cast("bigint"))


def _mean_units(c: str, digits: int):
    """The mean of a non-negative rounded column, half up, in whole units of its last decimal."""
    n = F.count(c)
    return F.floor((_units(c, digits) * 2 + n) / F.nullif(n * 2, F.lit(0)))


def financial_summary(decisions: DataFrame, keys=(ORG,)) -> DataFrame:
    """Financial KPIs (order value = Σ qty × mean price, as in the reference).

    Money is summed as whole cents (quantities and prices as whole 1/10,000), so
    no KPI depends on how the rows are partitioned.
    """
    order_value = (_units("recommended_order_qty", 4).cast("double") * _units("unit_price", 4).cast("double")
                   / (F.count("unit_price") * F.lit(1e8)))
    return decisions.groupBy(*keys).agg(
        (_units("inventory_value", 2) / 100).alias("total_inventory_value"),
        (_units("overstock_capital", 2) / 100).alias("total_overstock_capital"),
        (_units("stockout_revenue_loss", 2) / 100).alias("total_stockout_loss_risk"),
        (_units("carrying_cost", 2) / 100).alias("total_carrying_cost"),
        (_units("potential_savings", 2) / 100).alias("total_potential_savings"),
        rnd(order_value, 2).alias("total_recommended_order_value"),
        (_mean_units("inventory_turnover", 2) / 100).alias("avg_inventory_turnover"),
        (_mean_units("days_of_inventory", 1) / 10).alias("avg_days_of_inventory"),
        F.count(F.when(F.col("recommended_order_qty") > 0, 1)).alias("items_to_reorder"))


def scenario_decisions(stats: DataFrame, scenarios: list[Policy], multiplier=1.0, as_of=None) -> DataFrame:
    """H11 under every scenario; scenario 0 should be the baseline.

    Each series row is expanded by ``explode`` of a literal array of scenario
    structs — a fixed fan-out of len(scenarios) rows, partition-local.
    """
    arr = F.array(*[F.struct(F.lit(i).alias("scenario_id"), F.lit(s.name).alias("scenario"),
                             F.lit(s.z).alias("z"), F.lit(s.lead_time_days).alias("lead"),
                             F.lit(s.holding_cost_rate).alias("hcr"), F.lit(s.unit_cost).alias("unit_cost"),
                             F.lit(s.demand_growth).alias("growth"))
                    for i, s in enumerate(scenarios)])
    b = _with_as_of(stats, as_of).withColumn("_sc", F.explode(arr))
    p = {k: F.col(f"_sc.{k}") for k in ("z", "lead", "hcr", "unit_cost", "growth")}
    return b.select(F.col("_sc.scenario_id").alias("scenario_id"), F.col("_sc.scenario").alias("scenario"),
                    *SERIES, "as_of", "current_stock", *_decision_columns(p, multiplier))


def what_if_summary(scen: DataFrame) -> DataFrame:
    """Financial summary per tenant and scenario."""
    return financial_summary(scen, keys=(ORG, "scenario_id", "scenario"))


KPI_COLUMNS = ["total_inventory_value", "total_overstock_capital", "total_stockout_loss_risk",
               "total_carrying_cost", "total_potential_savings", "total_recommended_order_value",
               "avg_inventory_turnover", "avg_days_of_inventory", "items_to_reorder"]


def what_if_deltas(summary: DataFrame) -> DataFrame:
    """Scenario − baseline for every KPI (2 dp), baseline = scenario 0."""
    base = summary.filter(F.col("scenario_id") == 0).select(ORG, *[F.col(k).alias(f"_b_{k}") for k in KPI_COLUMNS])
    s = summary.filter(F.col("scenario_id") != 0).join(base, ORG)
    return s.select(ORG, "scenario_id", "scenario",
                    *[(rnd(F.col(k) - F.col(f"_b_{k}"), 2) if k != "items_to_reorder"
                       else F.col(k) - F.col(f"_b_{k}")).alias(f"delta_{k}") for k in KPI_COLUMNS])


def top_changes(scen: DataFrame, k: int = 10) -> DataFrame:
    """Top-k series by |Δ order qty| between each scenario and the baseline."""
    cols = ["recommended_order_qty", "safety_stock", "days_of_stock"]
    base = scen.filter(F.col("scenario_id") == 0).select(*SERIES, *[F.col(c).alias(f"{c}_base") for c in cols])
    s = scen.filter(F.col("scenario_id") != 0).select("scenario_id", "scenario", *SERIES,
                                                      *[F.col(c).alias(f"{c}_scen") for c in cols])
    j = s.join(base, SERIES).withColumn("delta_qty", F.col("recommended_order_qty_scen")
                                        - F.col("recommended_order_qty_base"))
    w = Window.partitionBy(ORG, "scenario_id").orderBy(F.desc(F.abs("delta_qty")), "item_id", "store_id")
    return (j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
             .select(ORG, "scenario_id", "scenario", "rank", "item_id", "store_id",
                     F.col("recommended_order_qty_base").alias("order_qty_baseline"),
                     F.col("recommended_order_qty_scen").alias("order_qty_scenario"),
                     F.col("safety_stock_base").alias("safety_stock_baseline"),
                     F.col("safety_stock_scen").alias("safety_stock_scenario"),
                     F.col("days_of_stock_base").alias("days_of_stock_baseline"),
                     F.col("days_of_stock_scen").alias("days_of_stock_scenario"), "delta_qty"))


def stock_estimate(fact: DataFrame, window: int = 28) -> DataFrame:
    """H01 alone: ``max(1.5 × sum of the last 28 rows, 10)`` per series."""
    w = Window.partitionBy(*SERIES).orderBy(F.desc("date"))
    r = fact.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= window)
    return (r.groupBy(*SERIES)
             .agg(F.sum(F.when(F.col("_rn") <= window, F.col("sales"))).alias("recent_sum"))
             .select(*SERIES, F.greatest(F.col("recent_sum") * 1.5, F.lit(10.0)).alias("estimated_stock")))
