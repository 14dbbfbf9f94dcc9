"""Column expressions for the business calendar: seasons, holidays, weather rules.

All of these are built-in Spark expressions (CASE / lookups), so they stay
inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------

SEASONS = ["Spring", "Summer", "Monsoon", "Autumn", "Winter"]
# month -> season: March Spring; April-June Summer; July-September Monsoon;
# October Autumn; every other month Winter.

# Fixed-date holidays (month, day, name), in calendar order.
FIXED_HOLIDAYS = [
    (2, 5, "Kashmir Day"),
    (3, 23, "Pakistan Day"),
    (5, 1, "Labour Day"),
    (8, 14, "Independence Day"),
    (9, 6, "Defence Day"),
    (9, 7, "Air Force Day"),
    (11, 9, "Iqbal Day"),
    (12, 25, "Quaid-e-Azam Day"),
]

# Islamic-calendar holidays by table year (one 2028 entry falls in 2027).
ISLAMIC_HOLIDAYS = {
    2024: [
        ("Shab-e-Miraj", "2024-02-08"), ("Shab-e-Barat", "2024-02-25"),
        ("Ramadan Starts", "2024-03-12"),
        ("Eid-ul-Fitr Day 1", "2024-04-10"), ("Eid-ul-Fitr Day 2", "2024-04-11"), ("Eid-ul-Fitr Day 3", "2024-04-12"),
        ("Eid-ul-Adha Day 1", "2024-06-17"), ("Eid-ul-Adha Day 2", "2024-06-18"), ("Eid-ul-Adha Day 3", "2024-06-19"),
        ("Muharram (Islamic New Year)", "2024-07-07"),
        ("Ashura (10th Muharram)", "2024-07-16"), ("Ashura Day 2", "2024-07-17"),
        ("Eid Milad-un-Nabi", "2024-09-16"),
    ],
    2025: [
        ("Shab-e-Miraj", "2025-01-27"), ("Shab-e-Barat", "2025-02-14"),
        ("Ramadan Starts", "2025-03-01"),
        ("Eid-ul-Fitr Day 1", "2025-03-31"), ("Eid-ul-Fitr Day 2", "2025-04-01"), ("Eid-ul-Fitr Day 3", "2025-04-02"),
        ("Eid-ul-Adha Day 1", "2025-06-07"), ("Eid-ul-Adha Day 2", "2025-06-08"), ("Eid-ul-Adha Day 3", "2025-06-09"),
        ("Muharram (Islamic New Year)", "2025-06-27"),
        ("Ashura (10th Muharram)", "2025-07-06"), ("Ashura Day 2", "2025-07-07"),
        ("Eid Milad-un-Nabi", "2025-09-05"),
    ],
    2026: [
        ("Shab-e-Miraj", "2026-01-16"), ("Shab-e-Barat", "2026-02-03"),
        ("Ramadan Starts", "2026-02-18"),
        ("Eid-ul-Fitr Day 1", "2026-03-20"), ("Eid-ul-Fitr Day 2", "2026-03-21"), ("Eid-ul-Fitr Day 3", "2026-03-22"),
        ("Eid-ul-Adha Day 1", "2026-05-28"), ("Eid-ul-Adha Day 2", "2026-05-29"), ("Eid-ul-Adha Day 3", "2026-05-30"),
        ("Muharram (Islamic New Year)", "2026-06-17"),
        ("Ashura (10th Muharram)", "2026-06-26"), ("Ashura Day 2", "2026-06-27"),
        ("Eid Milad-un-Nabi", "2026-08-26"),
    ],
    2027: [
        ("Shab-e-Miraj", "2027-01-05"), ("Shab-e-Barat", "2027-01-23"),
        ("Ramadan Starts", "2027-02-08"),
        ("Eid-ul-Fitr Day 1", "2027-03-09"), ("Eid-ul-Fitr Day 2", "2027-03-10"), ("Eid-ul-Fitr Day 3", "2027-03-11"),
        ("Eid-ul-Adha Day 1", "2027-05-17"), ("Eid-ul-Adha Day 2", "2027-05-18"), ("Eid-ul-Adha Day 3", "2027-05-19"),
        ("Muharram (Islamic New Year)", "2027-06-06"),
        ("Ashura (10th Muharram)", "2027-06-15"), ("Ashura Day 2", "2027-06-16"),
        ("Eid Milad-un-Nabi", "2027-08-15"),
    ],
    2028: [
        ("Shab-e-Miraj", "2027-12-25"), ("Shab-e-Barat", "2028-01-12"),
        ("Ramadan Starts", "2028-01-28"),
        ("Eid-ul-Fitr Day 1", "2028-02-26"), ("Eid-ul-Fitr Day 2", "2028-02-27"), ("Eid-ul-Fitr Day 3", "2028-02-28"),
        ("Eid-ul-Adha Day 1", "2028-05-05"), ("Eid-ul-Adha Day 2", "2028-05-06"), ("Eid-ul-Adha Day 3", "2028-05-07"),
        ("Muharram (Islamic New Year)", "2028-05-25"),
        ("Ashura (10th Muharram)", "2028-06-03"), ("Ashura Day 2", "2028-06-04"),
        ("Eid Milad-un-Nabi", "2028-08-03"),
    ],
}

# Holiday keyword -> category, checked in this order (first match wins).
HOLIDAY_KEYWORDS = [
    ("Ramadan", "ramadan"),
    ("Eid-ul-Fitr", "eid"),
    ("Eid-ul-Adha", "eid"),
    ("Eid Milad", "religious"),
    ("Pakistan Day", "national"),
    ("Independence Day", "national"),
    ("Defence Day", "national"),
    ("Iqbal Day", "national"),
    ("Quaid-e-Azam Day", "national"),
    ("Ashura", "religious"),
    ("Shab-e-Barat", "religious"),
    ("Shab-e-Miraj", "religious"),
    ("Muharram", "religious"),
    ("Labour Day", "national"),
]
# Fallback words after the keyword table: ramadan/ramzan -> ramadan; eid -> eid;
# ashura/muharram -> religious; independence/pakistan day/defence -> national.

# Category -> (demand multiplier, pre-holiday days, advice).
HOLIDAY_DEMAND = {
    "ramadan": (1.3, 14, "Stock up on dates, juices, beverages, and frozen foods before Ramadan."),
    "eid": (1.5, 7, "Increase stock of soft drinks, snacks, sweets, and gifts before Eid."),
    "national": (1.2, 3, "Stock up on beverages and snacks for national holiday celebrations."),
}

# Season -> default weather (temp C, humidity %, rain mm, condition).
SEASON_WEATHER = {
    "Spring": (25, 50, 5, "Clear"),
    "Summer": (35, 40, 10, "Clear"),
    "Monsoon": (32, 75, 50, "Rain"),
    "Autumn": (22, 55, 5, "Clear"),
    "Winter": (15, 60, 10, "Clear"),
}

# Season -> demand multiplier applied to inventory.
SEASON_MULTIPLIER = {"Summer": 1.15, "Monsoon": 1.05, "Winter": 1.10, "Spring": 1.0, "Autumn": 1.0}

# Season -> (high-demand keywords, low-demand keywords, advice).
SEASONAL_PRODUCT_DEMAND = {
    "Summer": (
        ["cold drink", "ice cream", "water", "mineral water", "juice",
         "soft drink", "soda", "lemonade", "yogurt drink", "lassi",
         "melon", "mango", "watermelon", "cucumber", "coconut water",
         "ice", "fan", "air conditioner", "sunscreen", "shampoo"],
        ["soup", "coffee", "hot tea", "blanket", "heater", "winter", "jacket", "sweater", "gloves"],
        "☀️ Hot summer — stock up on cold drinks, ice cream, juices, and beverages.",
    ),
    "Monsoon": (
        ["soup", "tea", "coffee", "pakora mix", "snacks", "kachori",
         "samosa", "medicine", "cold relief", "cough syrup",
         "umbrella", "raincoat", "towel", "soap", "detergent"],
        ["ice cream", "cold drink", "sunblock", "sunglasses"],
        "🌧️ Monsoon season — stock umbrellas, raincoats, hot beverages, and snacks.",
    ),
    "Winter": (
        ["tea", "coffee", "green tea", "kashmiri chai", "soup",
         "blanket", "heater", "shawl", "jacket", "sweater",
         "gloves", "muffler", "wool", "winter", "hoodie",
         "socks", "quilt", "hot water bottle"],
        ["ice cream", "cold drink", "mineral water", "soda", "air conditioner", "fan", "sunscreen"],
        "❄️ Cold weather — stock up on tea, coffee, soups, blankets, and winter essentials.",
    ),
    "Spring": (
        ["juice", "fresh fruit", "yogurt", "salad", "green vegetable"],
        [],
        "🌸 Spring — focus on fresh produce, dairy, and light beverages.",
    ),
    "Autumn": (
        ["tea", "coffee", "soup", "dry fruit", "nuts"],
        ["ice cream", "cold drink"],
        "🍂 Autumn — mild demand for warm beverages and dry fruits.",
    ),
}
SUMMER_HEAT_THRESHOLD = 35
WINTER_COLD_THRESHOLD = 10

# ---------------------------------------------------------------------------
# Expressions
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def season_of_month(month) -> Column:
    m = _c(month)
    return (F.when(m == 3, "Spring")
             .when((m >= 4) & (m <= 6), "Summer")
             .when((m >= 7) & (m <= 9), "Monsoon")
             .when(m == 10, "Autumn")
             .otherwise("Winter"))


def season(date) -> Column:
    """season of a date."""
    return season_of_month(F.month(_c(date)))


def season_sql(date_expr: str) -> str:
    """The same rule as SQL text (DuckDB and Spark SQL accept it)."""
    m = f"month({date_expr})"
    return (f"CASE WHEN {m} = 3 THEN 'Spring' WHEN {m} BETWEEN 4 AND 6 THEN 'Summer' "
            f"WHEN {m} BETWEEN 7 AND 9 THEN 'Monsoon' WHEN {m} = 10 THEN 'Autumn' "
            f"ELSE 'Winter' END")


def weekday0(date) -> Column:
    """Day of week with Monday = 0 (pandas ``dayofweek``)."""
    return F.weekday(_c(date))


def holiday_category(name) -> Column:
    """ordered keyword match of a holiday name to its category."""
    n = F.lower(_c(name))
    expr = None
    for kw, cat in HOLIDAY_KEYWORDS:
        cond = n.contains(kw.lower())
        expr = F.when(cond, cat) if expr is None else expr.when(cond, cat)
    expr = (expr.when(n.contains("ramadan") | n.contains("ramzan"), "ramadan")
                .when(n.contains("eid"), "eid")
                .when(n.contains("ashura") | n.contains("muharram"), "religious")
                .when(n.contains("independence") | n.contains("pakistan day") | n.contains("defence"),
                      "national")
                .otherwise("other"))
    return F.when(_c(name).isNull(), "none").otherwise(expr)


def _by_category(cat, idx: int, default):
    c = _c(cat)
    expr = None
    for k, vals in HOLIDAY_DEMAND.items():
        expr = F.when(c == k, F.lit(vals[idx])) if expr is None else expr.when(c == k, F.lit(vals[idx]))
    return expr.otherwise(F.lit(default))


def holiday_multiplier(cat) -> Column:
    return _by_category(cat, 0, 1.0)


def holiday_pre_days(cat) -> Column:
    return _by_category(cat, 1, 0)


def holiday_advice(cat) -> Column:
    return _by_category(cat, 2, "")


def season_lookup(season_col, idx: int, default) -> Column:
    s = _c(season_col)
    expr = None
    for k, vals in SEASON_WEATHER.items():
        expr = F.when(s == k, F.lit(vals[idx])) if expr is None else expr.when(s == k, F.lit(vals[idx]))
    return expr.otherwise(F.lit(default))


def season_multiplier(season_col) -> Column:
    s = _c(season_col)
    expr = None
    for k, v in SEASON_MULTIPLIER.items():
        expr = F.when(s == k, F.lit(v)) if expr is None else expr.when(s == k, F.lit(v))
    return expr.otherwise(F.lit(1.0))


def weather_impact_multiplier(temp, season_col, condition=None) -> Column:
    """temperature band multiplier, times 1.1 for rain or Monsoon."""
    t = _c(temp)
    base = (F.when(t >= 35, 1.3).when(t >= 30, 1.15).when(t <= 10, 1.25)
             .when(t <= 15, 1.1).otherwise(1.0))
    wet = _c(season_col) == "Monsoon"
    if condition is not None:
        wet = wet | F.lower(F.coalesce(_c(condition), F.lit(""))).contains("rain")
    return F.when(wet, base * 1.1).otherwise(base)


def extreme_weather_advice(temp, season_col, humidity, condition, rain) -> Column:
    """' | '-joined advice lines; season advice when no rule fires."""
    t, h = _c(temp), _c(humidity)
    cond = F.lower(F.coalesce(_c(condition), F.lit("")))
    r = F.coalesce(_c(rain), F.lit(0.0))
    parts = F.filter(F.array(
        F.when(t >= SUMMER_HEAT_THRESHOLD, F.concat(
            F.lit("🔥 Extreme heat ("), F.format_string("%.0f", t.cast("double")),
            F.lit("°C) — high demand for cold drinks, water, ice cream."))),
        F.when(t <= WINTER_COLD_THRESHOLD, F.concat(
            F.lit("❄️ Cold wave ("), F.format_string("%.0f", t.cast("double")),
            F.lit("°C) — stock up on tea, coffee, soups, warm clothing."))),
        F.when((r > 10) | cond.contains("rain"),
               F.lit("🌧️ Heavy rain — umbrellas, raincoats, indoor snacks will see higher demand.")),
        F.when(h > 80, F.lit("💧 High humidity — beverages and cold drinks may see increased demand.")),
    ), lambda x: x.isNotNull())
    season_adv = seasonal_advice(season_col)
    return (F.when(F.size(parts) > 0, F.array_join(parts, " | "))
             .when(season_adv.isNotNull(), season_adv)
             .otherwise(F.lit("Normal conditions — standard demand patterns.")))


def seasonal_advice(season_col) -> Column:
    s = _c(season_col)
    expr = None
    for k, (_, _, adv) in SEASONAL_PRODUCT_DEMAND.items():
        expr = F.when(s == k, F.lit(adv)) if expr is None else expr.when(s == k, F.lit(adv))
    return expr


def seasonal_keywords(season_col, which: int) -> Column:
    """Array of high (0) or low (1) demand keywords for the season."""
    s = _c(season_col)
    expr = None
    for k, vals in SEASONAL_PRODUCT_DEMAND.items():
        arr = F.array(*[F.lit(x) for x in vals[which]]) if vals[which] else F.array().cast("array<string>")
        expr = F.when(s == k, arr) if expr is None else expr.when(s == k, arr)
    return expr.otherwise(F.array().cast("array<string>"))
