"""Small column helpers shared by all operators."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORG = "organization_id"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b, default=None) -> Column:
    """a / b, NULL (or ``default``) when b is 0 or NULL — never raises under ANSI."""
    q = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(default))


def finite(c) -> Column:
    """NaN / ±Inf -> NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def finite_all(df: DataFrame) -> DataFrame:
    """B16 over every floating column of a frame."""
    cols = [finite(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def round_half_away(c: Column, digits: int = 4) -> Column:
    """``round(c * 10^d) / 10^d`` in binary floating point — the same steps SQL
    engines such as DuckDB take, so ties resolve identically (``F.round``
    rounds the decimal string of the double instead)."""
    m = float(10 ** digits)
    return F.round(c * m, 0) / m


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column and widen every integer column to BIGINT
    (stable values and types for cross-engine comparison)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_away(F.col(f.name).cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def as_date(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (_dt.date, _dt.datetime)):
        value = value.strftime("%Y-%m-%d")
    return F.to_date(F.lit(value))


def with_as_of(df: DataFrame, as_of=None, date_col: str = "date", name: str = "as_of") -> DataFrame:
    """Attach the reference date of each tenant.

    ``as_of`` given -> the same literal date for every tenant. ``None`` -> the
    tenant's latest ``date``: a grouped max (partial aggregation, one row per
    tenant) joined back on the tenant key; the planner broadcasts that tiny
    side, so the fact is not re-shuffled by tenant (which would put a hot
    tenant into one task).
    """
    if as_of is not None:
        return df.withColumn(name, as_date(as_of))
    latest = df.groupBy(ORG).agg(F.max(date_col).alias(name))
    return df.join(per_tenant(latest), ORG, "left")


def tenant_as_of(df: DataFrame, as_of=None, date_col: str = "date", name: str = "as_of") -> DataFrame:
    """One row per tenant with its reference date."""
    if as_of is not None:
        return df.select(ORG).distinct().withColumn(name, as_date(as_of))
    return df.groupBy(ORG).agg(F.max(date_col).alias(name))


BROADCAST_MAX_ROWS = 1_000_000


DIGITS = 4  # of 16 bits, of a double's 64-bit image


def ordered_image(x: Column) -> Column:
    """The 64 bits of a double as a long in the same order (-0.0 as 0.0; NaN last)."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF)))


def exact_quantiles(df: DataFrame, keys: list[str], c, quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles (as pandas / ``quantile_cont``) per group,
    one column per name; groups without values are left out.

    Radix selection: values are counted per (group, value) first, and stored; then each of four rounds counts
    one 16-bit digit of the values' order-preserving 64-bit images, in the cells that still hold a wanted
    order statistic, and picks the digits it falls on. Rounds are four whatever the values, and what
    is ordered in a task is never more than one cell's 65,536 digit counts. At most two cells for each group and
    quantile are wanted; up to the bound on broadcasts they are sent to the counts.
    """
    from tillsight.sources.tables import materialize
    v = df.select(*keys, (col(c).cast("double") + F.lit(0.0)).alias("_x")).filter(F.col("_x").isNotNull())
    counts = v.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")).withColumn("_image", ordered_image(F.col("_x")))
    digits = [F.shiftright("_image", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) if i else F.shiftright("_image", 48) for i in range(DIGITS)]
    counts = materialize(counts.select(*keys, "_x", "_c", *[d.cast("int").alias(f"_d{i}") for i, d in enumerate(digits)]), "value-counts")
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    sent = F.broadcast if n.count() * 2 * len(quantiles) <= BROADCAST_MAX_ROWS else lambda x: x
    places = {q: F.lit(float(q)) * (F.col("_n") - 1) for q in quantiles.values()}
    ranks = {f"_r{i}": f(places[q]).cast("long") for i, (q, f) in enumerate((q, f) for q in quantiles.values() for f in (F.floor, F.ceil))}
    wanted = n.select(*keys, "_n", *[r.alias(c) for c, r in ranks.items()])
    cell = list(keys)
    for i in range(DIGITS):
        hist = counts.join(sent(wanted), cell).groupBy(*cell, f"_d{i}").agg(F.sum("_c").alias("_m"), F.max("_x").alias("_x"), *[F.max(c).alias(c) for c in ("_n", *ranks)])
        upto = Window.partitionBy(*cell).orderBy(f"_d{i}").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 2^16 rows
        hist = hist.withColumn("_b", F.sum("_m").over(upto) - F.col("_m"))
        cell = [*cell, f"_d{i}"]
        inside = {c: F.when((F.col(c) >= F.col("_b")) & (F.col(c) < F.col("_b") + F.col("_m")), F.col(c) - F.col("_b")) for c in ranks}  # NULL: in another cell
        last = ["_x"] if i == DIGITS - 1 else []
        wanted = hist.select(*cell, *last, "_n", *[r.alias(c) for c, r in inside.items()]).filter(F.coalesce(*ranks).isNotNull())
    values = wanted.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when(F.col(c).isNotNull(), F.col("_x"))).alias(c) for c in ranks])
    out = [(F.col(f"_r{2 * i}") + (places[q] - F.floor(places[q])) * (F.col(f"_r{2 * i + 1}") - F.col(f"_r{2 * i}"))).alias(name)
           for i, (name, q) in enumerate(quantiles.items())]
    return values.select(*keys, *out)


def split_rank(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """``row_number()`` over (``keys``, ordered by ``order``) without bringing a group together: rows are range
    partitioned by (keys, order) and stored, ranked within each part, and each part's number of earlier rows of the
    same key is added. A key with a third of all rows is spread over a third of the parts. ``order`` should be total.
    """
    from tillsight.sources.tables import materialize
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, so that a part's number stays its own whatever is computed again
    parts = materialize(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = parts.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row per part
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).select(
        F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(sizes, same).select(*df.columns, (F.col("_before") + F.col("_local")).cast("int").alias(name))


def per_tenant(df: DataFrame) -> DataFrame:
    """Broadcast a frame that holds one row per tenant (per-tenant dates,
    quantiles, ranges, flags). Its size is bounded by the number of tenants —
    a registry-sized count, not a data-sized one — so it is shipped to the
    big side instead of shuffling the big side by tenant (which would also put
    a hot tenant into one task)."""
    return F.broadcast(df)


PART_ROWS = 1_000_000  # rows that one task sorts or groups, about


def dealt(df: DataFrame, keys, rows: int, part_rows: int | None = None) -> DataFrame:
    """``df`` of ``rows`` rows dealt by ``keys`` over as many parts as keep about ``part_rows`` (``PART_ROWS``) in each, if
    these are more than the session's shuffle partitions: what a task sorts or groups does not grow with the table."""
    parts = -(-rows // (part_rows or PART_ROWS))
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


_ROW_COUNTS: dict = {}


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, key=None) -> DataFrame:
    """Broadcast-hint ``df`` only after proving it small: one count over the
    (already projected, dimension-sized) frame. Beyond ``max_rows`` the frame
    is returned as is and the planner falls back to a shuffle join.

    Spark's own size estimate multiplies the sizes of joined inputs, so a
    chain of tiny dimension joins looks huge to the planner; the explicit
    count gives the bound the estimate lacks.
    """
    if key is not None and key in _ROW_COUNTS:
        n = _ROW_COUNTS[key]
    else:
        n = df.count()
        if key is not None:
            _ROW_COUNTS[key] = n
    return F.broadcast(df) if n <= max_rows else df


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
