"""Registered inventory / purchase / what-if queries (H01-H14) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.operators import inventory as H
from tillsight.plans.catalog import query, r4, with_fact
from tillsight.sources.tables import SalesTables, sales_fact

Z95 = repr(H.Policy().z)
SCENARIOS = [
    H.Policy(name="baseline"),
    H.Policy(service_level=0.99, lead_time_days=10, holding_cost_rate=0.3, demand_growth=0.05, name="cautious"),
    H.Policy(service_level=0.9, lead_time_days=5, holding_cost_rate=0.2, unit_cost=12.0, demand_growth=-0.1,
             name="lean"),
]

STATS_SQL = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY organization_id, item_id, store_id ORDER BY date DESC) AS rn
           FROM fact),
st0 AS (SELECT organization_id, item_id, store_id, COUNT(sales) AS n_obs, AVG(sales) AS mean_sales,
               STDDEV_POP(sales) AS std_pop, MAX(CASE WHEN rn = 1 THEN sell_price END) AS last_price,
               MAX(date) AS last_date, SUM(CASE WHEN rn <= 28 THEN sales END) AS recent_sum
        FROM ranked GROUP BY organization_id, item_id, store_id),
tenant_asof AS (SELECT organization_id, MAX(date) AS as_of FROM fact GROUP BY organization_id)"""

STATS_STOCK = STATS_SQL + """,
st AS (SELECT s.*, a.as_of, COALESCE(k.current_stock, 0.0) AS current_stock
       FROM st0 s JOIN tenant_asof a USING (organization_id) LEFT JOIN stock k USING (organization_id, item_id, store_id))"""

STATS_EST = STATS_SQL + """,
st AS (SELECT s.*, a.as_of, greatest(recent_sum * 1.5, 10.0) AS current_stock
       FROM st0 s JOIN tenant_asof a USING (organization_id))"""


def _stats(spark, sf, with_stock=True, tables=None):
    t = tables or SalesTables(spark, sf)
    return H.series_stats(t.fact(), t.stock() if with_stock else None)


def _rec_raw(stats_cte: str) -> str:
    """Unrounded H06 columns as one statement over the fact CTEs."""
    return with_fact(f"""
WITH {stats_cte},
b AS (SELECT *, mean_sales * 1.0 AS a,
             CASE WHEN std_pop IS NULL OR std_pop = 0 THEN mean_sales * 1.0 * 0.1 ELSE std_pop END AS sd FROM st),
c AS (SELECT *, greatest({Z95} * sd * sqrt(7), 0) AS ss FROM b),
d AS (SELECT *, a * 7 + ss AS rop,
             CASE WHEN a * 365 <= 0 THEN 0.0 ELSE greatest(sqrt(2 * a * 365 * 100 / (10 * 0.25)), 1) END AS q,
             CASE WHEN a > 0 THEN current_stock / a END AS days FROM c)
SELECT organization_id, item_id, store_id, as_of, current_stock, a AS avg_daily_demand, sd AS demand_std,
  ss AS safety_stock, rop AS reorder_point, q AS eoq, greatest(0, rop - current_stock) AS recommended_order_qty,
  CASE WHEN current_stock < ss THEN 'CRITICAL' WHEN current_stock < rop THEN 'LOW'
       WHEN current_stock > rop + q THEN 'EXCESS' ELSE 'OK' END AS status,
  COALESCE(days, 999.0) AS days_of_stock,
  CASE WHEN days < 365 THEN round(days, 1) ELSE 999.0 END AS stockout_in_days,
  CASE WHEN days < 365 THEN CAST(as_of + to_days(CAST(trunc(days) AS INTEGER)) AS DATE) END AS stockout_date,
  COALESCE(days > 60, false) AS is_overstock,
  CASE WHEN days > 60 THEN greatest(0, current_stock - a * 60) END AS excess_units,
  1.0::DOUBLE AS demand_multiplier_used
FROM d""")


def _rec_sql(stats_cte: str) -> str:
    cols = ["current_stock", "avg_daily_demand", "demand_std", "safety_stock", "reorder_point", "eoq",
            "recommended_order_qty", "days_of_stock", "stockout_in_days", "excess_units"]
    return f"""SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in cols)})
FROM ({_rec_raw(stats_cte)}) rec"""


@query("h06_inventory_recommendations", _rec_sql(STATS_STOCK))
def h06(spark, sf):
    """Safety stock, reorder point, EOQ, status and stockout date per series."""
    return H.recommendations(_stats(spark, sf))


@query("h06_recommendations_estimated_stock", _rec_sql(STATS_EST))
def h06e(spark, sf):
    """H06 for a tenant with no stock table: stock estimated from the last 28 rows."""
    return H.recommendations(_stats(spark, sf, with_stock=False))


@query("h01_stock_estimate", with_fact("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY organization_id, item_id, store_id ORDER BY date DESC) AS rn
           FROM fact)
SELECT organization_id, item_id, store_id,
       round(greatest(SUM(CASE WHEN rn <= 28 THEN sales END) * 1.5, 10.0), 4) AS estimated_stock
FROM r GROUP BY organization_id, item_id, store_id"""))
def h01(spark, sf):
    """Stock estimate max(1.5 × last-28-row sales, 10) per series."""
    return H.stock_estimate(sales_fact(spark, sf))


@query("h07_stockout_predictions", f"""
WITH rec AS ({_rec_raw(STATS_STOCK)})
SELECT organization_id, item_id, store_id, round(current_stock, 4) AS current_stock,
       round(avg_daily_demand, 4) AS avg_daily_demand,
       round(current_stock / avg_daily_demand, 1) AS days_remaining,
       CAST(as_of + to_days(CAST(trunc(current_stock / avg_daily_demand) AS INTEGER)) AS DATE)
         AS predicted_stockout_date,
       current_stock / avg_daily_demand < 7 AS is_critical
FROM rec WHERE avg_daily_demand > 0 AND current_stock / avg_daily_demand < 365
  AND round(current_stock / avg_daily_demand, 1) < 90""")
def h07(spark, sf):
    """Series expected to run out within 90 days."""
    return _h07(spark, sf)


def _h07(spark, sf):
    return H.stockout_predictions(H.recommendations(_stats(spark, sf)))


@query("h08_overstock_items", f"""
WITH rec AS ({_rec_raw(STATS_STOCK)})
SELECT organization_id, item_id, store_id, round(current_stock, 4) AS current_stock,
       round(avg_daily_demand, 4) AS avg_daily_demand,
       round(current_stock / avg_daily_demand, 1) AS days_of_stock,
       round(greatest(0, current_stock - avg_daily_demand * 60), 4) AS excess_units,
       'Stock covers ' || CAST(round_even(round(current_stock / avg_daily_demand, 1), 0) AS BIGINT)
         || ' days (threshold: 60)' AS reason
FROM rec WHERE avg_daily_demand > 0 AND current_stock / avg_daily_demand > 60""")
def h08(spark, sf):
    """Series holding more than 60 days of stock, with excess units."""
    return H.overstock_items(H.recommendations(_stats(spark, sf)), 60)


@query("h09_stockout_risk", f"""
WITH rec AS ({_rec_raw(STATS_STOCK)})
SELECT organization_id, item_id, store_id, status, round(days_of_stock, 4) AS days_of_stock FROM rec
WHERE days_of_stock < 7 OR status IN ('LOW', 'CRITICAL')""")
def h09(spark, sf):
    """At-risk series: under 7 days of stock or LOW / CRITICAL."""
    return H.stockout_risk(H.recommendations(_stats(spark, sf))).select(
        *H.SERIES, "status", "days_of_stock")


@query("h09_excess_inventory", f"""
WITH rec AS ({_rec_raw(STATS_STOCK)})
SELECT organization_id, item_id, store_id, status, round(days_of_stock, 4) AS days_of_stock FROM rec WHERE days_of_stock > 60""")
def h09x(spark, sf):
    """Series with more than 60 days of stock."""
    return H.excess_inventory(H.recommendations(_stats(spark, sf))).select(
        *H.SERIES, "status", "days_of_stock")


@query("h10_inventory_metrics", f"""
WITH rec AS ({_rec_raw(STATS_STOCK)})
SELECT organization_id, COUNT(*) AS total_items,
  COUNT(CASE WHEN status = 'OK' THEN 1 END) AS items_ok, COUNT(CASE WHEN status = 'LOW' THEN 1 END) AS items_low,
  COUNT(CASE WHEN status = 'CRITICAL' THEN 1 END) AS items_critical,
  COUNT(CASE WHEN status = 'EXCESS' THEN 1 END) AS items_excess,
  {r4('AVG(days_of_stock)', 'avg_days_of_stock')}, {r4('SUM(safety_stock)', 'total_safety_stock')},
  {r4('SUM(recommended_order_qty)', 'total_recommended_orders')},
  COUNT(CASE WHEN recommended_order_qty > 0 THEN 1 END) AS items_need_reorder
FROM rec GROUP BY organization_id""")
def h10(spark, sf):
    """Inventory KPIs per tenant."""
    return H.inventory_metrics(H.recommendations(_stats(spark, sf)))


def _dec_sql(stats_cte: str, scen: list[H.Policy]) -> str:
    vals = ", ".join(f"({i}, '{p.name}', {p.z!r}, {p.lead_time_days}, {p.holding_cost_rate}, {p.unit_cost}, "
                     f"{p.demand_growth})" for i, p in enumerate(scen))
    return f"""
WITH {stats_cte},
sc(scenario_id, scenario, z, lead, hcr, unit_cost, growth) AS (VALUES {vals}),
b AS (SELECT st.*, sc.*, mean_sales * 1.0 * (1 + growth) AS a FROM st, sc),
c AS (SELECT *, CASE WHEN std_pop IS NULL OR std_pop = 0 THEN a * 0.1 ELSE std_pop END AS sd FROM b),
d AS (SELECT *, greatest(z * sd * sqrt(lead), 0) AS ss FROM c),
e AS (SELECT *, a * lead + ss AS rop,
         CASE WHEN a * 365 <= 0 THEN 0.0 ELSE greatest(sqrt(2 * a * 365 * 100 / (10 * 0.25)), 1) END AS q,
         CASE WHEN a > 0 THEN (current_stock - (a * lead + ss)) / a ELSE 999.0 END AS dtr,
         CASE WHEN a > 0 THEN current_stock / a ELSE 999.0 END AS dso,
         CASE WHEN last_price IS NULL OR last_price = 0 THEN unit_cost ELSE last_price END AS price FROM d),
f AS (SELECT *, dtr <= lead AS today,
         CASE WHEN dtr <= lead THEN 0 ELSE CAST(floor(dtr) AS BIGINT) END AS ooff,
         CASE WHEN dso > 90 THEN greatest(0, current_stock - a * 90) ELSE 0.0 END AS excess FROM e),
g AS (SELECT *, ooff + lead AS aoff,
         CASE WHEN dso < 365 AND dso < ooff + lead AND a > 0
              THEN greatest(0, floor(ooff + lead - dso)) * a * price ELSE 0.0 END AS loss FROM f)
SELECT CAST(scenario_id AS BIGINT) AS scenario_id, scenario, organization_id, item_id, store_id, as_of,
  current_stock,
  a AS avg_daily_demand, sd AS demand_std, ss AS safety_stock, rop AS reorder_point, q AS eoq,
  greatest(0, rop + a * lead - current_stock) AS recommended_order_qty, today AS order_today,
  CASE WHEN today OR dtr < 365 THEN CAST(as_of + to_days(CAST(ooff AS INTEGER)) AS DATE) END AS order_date,
  CASE WHEN aoff <= date_diff('day', as_of, DATE '9999-12-31') THEN CAST(as_of + to_days(CAST(aoff AS INTEGER)) AS DATE) END AS arrival_date,
  CASE WHEN dso < 365 THEN round(dso, 1) END AS stockout_in_days,
  CASE WHEN dso < 365 THEN CAST(as_of + to_days(CAST(floor(dso) AS INTEGER)) AS DATE) END AS stockout_date,
  CASE WHEN current_stock < ss THEN 'CRITICAL' WHEN current_stock < rop THEN 'LOW'
       WHEN current_stock > rop + q THEN 'EXCESS' ELSE 'OK' END AS status,
  CASE WHEN dso < 365 THEN round(dso, 1) ELSE 999.0 END AS days_of_stock,
  price AS unit_price, round(current_stock * price, 2) AS inventory_value, round(excess, 1) AS excess_units,
  round(excess * price, 2) AS overstock_capital, round(loss, 2) AS stockout_revenue_loss,
  round(current_stock * price * hcr, 2) AS carrying_cost,
  round(CASE WHEN current_stock > 0 THEN a * 365 / current_stock END, 2) AS inventory_turnover,
  round(dso, 1) AS days_of_inventory, round(excess * price * hcr + loss, 2) AS potential_savings
FROM g"""


DEC_COLS = ["avg_daily_demand", "demand_std", "safety_stock", "reorder_point", "eoq", "recommended_order_qty"]


def _round_sel(cols_double: list[str]) -> str:
    return ", ".join(r4(c, c) for c in cols_double)


@query("h11_purchase_decisions", with_fact(f"""
WITH dec AS ({_dec_sql(STATS_STOCK, SCENARIOS[:1])})
SELECT organization_id, item_id, store_id, as_of, {r4('current_stock', 'current_stock')},
  {_round_sel(DEC_COLS)}, order_today, order_date, arrival_date, stockout_in_days, stockout_date, status,
  days_of_stock, {r4('unit_price', 'unit_price')}, inventory_value, excess_units, overstock_capital,
  stockout_revenue_loss, carrying_cost, inventory_turnover, days_of_inventory, potential_savings
FROM dec"""))
def h11(spark, sf):
    """Purchase decision with order timing and money per series (baseline policy)."""
    return H.purchase_decisions(_stats(spark, sf))


def _cents(c: str, name: str) -> str:
    """A sum of money in DECIMAL, independent of the order of the rows."""
    return f"CAST(SUM(CAST({c} AS DECIMAL(28, 2))) AS DOUBLE) AS {name}"


KPI_SQL = f"""{_cents('inventory_value', 'total_inventory_value')},
  {_cents('overstock_capital', 'total_overstock_capital')}, {_cents('stockout_revenue_loss', 'total_stockout_loss_risk')},
  {_cents('carrying_cost', 'total_carrying_cost')}, {_cents('potential_savings', 'total_potential_savings')},
  round(CAST(SUM(CAST(round(recommended_order_qty * 10000) AS BIGINT)) AS DOUBLE)
        * CAST(SUM(CAST(round(unit_price * 10000) AS BIGINT)) AS DOUBLE) / (COUNT(unit_price) * 1e8), 2) AS total_recommended_order_value,
  floor((SUM(CAST(round(inventory_turnover * 100) AS BIGINT)) * 2 + COUNT(inventory_turnover)) / (COUNT(inventory_turnover) * 2)) / 100
    AS avg_inventory_turnover,
  floor((SUM(CAST(round(days_of_inventory * 10) AS BIGINT)) * 2 + COUNT(days_of_inventory)) / (COUNT(days_of_inventory) * 2)) / 10
    AS avg_days_of_inventory,
  COUNT(CASE WHEN recommended_order_qty > 0 THEN 1 END) AS items_to_reorder"""


@query("h12_financial_summary", with_fact(f"""
WITH dec AS ({_dec_sql(STATS_STOCK, SCENARIOS[:1])})
SELECT organization_id, {KPI_SQL}
FROM dec GROUP BY organization_id"""))
def h12(spark, sf):
    """Financial KPIs of the purchase decisions per tenant."""
    return H.financial_summary(H.purchase_decisions(_stats(spark, sf)))


def _scen_sql(tail: str) -> str:
    return with_fact(f"WITH dec AS ({_dec_sql(STATS_STOCK, SCENARIOS)}){tail}")


SUMMARY_TAIL = """, summ AS (
SELECT organization_id, scenario_id, scenario, """ + KPI_SQL + """
FROM dec GROUP BY organization_id, scenario_id, scenario)"""


@query("h13_what_if_summary", _scen_sql(SUMMARY_TAIL + "\nSELECT * FROM summ"))
def h13(spark, sf):
    """Financial KPIs per tenant under the baseline and two what-if scenarios."""
    return H.what_if_summary(H.scenario_decisions(_stats(spark, sf), SCENARIOS))


@query("h14_what_if_deltas", _scen_sql(SUMMARY_TAIL + f"""
SELECT s.organization_id, s.scenario_id, s.scenario,
  {', '.join(f'round(s.{k} - b.{k}, 2) AS delta_{k}' if k != 'items_to_reorder'
             else f's.{k} - b.{k} AS delta_{k}' for k in H.KPI_COLUMNS)}
FROM summ s JOIN summ b ON b.organization_id = s.organization_id AND b.scenario_id = 0
WHERE s.scenario_id <> 0"""))
def h14(spark, sf):
    """Scenario − baseline deltas of every financial KPI."""
    return H.what_if_deltas(H.what_if_summary(H.scenario_decisions(_stats(spark, sf), SCENARIOS)))


@query("h14_top_changes", _scen_sql(f"""
SELECT s.organization_id, s.scenario_id, s.scenario,
  CAST(row_number() OVER (PARTITION BY s.organization_id, s.scenario_id
       ORDER BY abs(s.recommended_order_qty - b.recommended_order_qty) DESC, s.item_id, s.store_id) AS BIGINT) AS rank,
  s.item_id, s.store_id, {r4('b.recommended_order_qty', 'order_qty_baseline')},
  {r4('s.recommended_order_qty', 'order_qty_scenario')}, {r4('b.safety_stock', 'safety_stock_baseline')},
  {r4('s.safety_stock', 'safety_stock_scenario')}, {r4('b.days_of_stock', 'days_of_stock_baseline')},
  {r4('s.days_of_stock', 'days_of_stock_scenario')},
  {r4('s.recommended_order_qty - b.recommended_order_qty', 'delta_qty')}
FROM dec s JOIN dec b ON b.scenario_id = 0 AND s.organization_id = b.organization_id
  AND s.item_id = b.item_id AND s.store_id = b.store_id
WHERE s.scenario_id <> 0
QUALIFY rank <= 10"""))
def h14t(spark, sf):
    """Top ten series by |Δ order quantity| per scenario."""
    return H.top_changes(H.scenario_decisions(_stats(spark, sf), SCENARIOS), 10)

