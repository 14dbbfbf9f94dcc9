"""Upload / push ingestion, cleaning, idempotent upserts and catalogue tables
(A01-A19, B01-B19).

Everything is set-based: one alias projection, one coercion ``select``, one
dedupe window, one anti join per dimension and one keyed merge per table. The
upsert rewrites only the tenant and month partitions touched by the batch
(dynamic partition overwrite) after staging the merged rows in the shared checkpoint
folder — a job cannot overwrite the files it is reading, and a staged copy
makes a retried job idempotent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions.core import ORG, round_half_away as rnd, split_rank
from tillsight.session import scratch_path

# ---------------------------------------------------------------------------
# Accepted upload column names per canonical column (any case).
# ---------------------------------------------------------------------------
DATE_ALIASES = ["date", "day", "transaction_date", "sale_date", "order_date", "timestamp", "datetime"]
SALES_ALIASES = ["sales", "quantity", "demand", "qty", "units_sold", "volume", "sales_quantity", "units"]
ITEM_ALIASES = ["item_id", "product_id", "sku", "product", "item", "article"]
STORE_ALIASES = ["store_id", "store", "location", "warehouse", "branch"]
PRICE_ALIASES = ["sell_price", "price", "unit_price", "revenue_per_unit"]
DEFAULT_ITEM = "PRODUCT_001"
DEFAULT_STORE = "STORE_001"

ALIASES = [("date", DATE_ALIASES), ("sales", SALES_ALIASES), ("item_id", ITEM_ALIASES),
           ("store_id", STORE_ALIASES), ("sell_price", PRICE_ALIASES)]

SALES_TABLE_SCHEMA = T.StructType([
    T.StructField(ORG, T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("store_id", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("sales", T.DoubleType()), T.StructField("revenue", T.DoubleType()),
    T.StructField("batch_id", T.StringType()), T.StructField("ingested_at", T.TimestampType()),
])
SALES_KEY = [ORG, "date", "item_id", "store_id"]
INVENTORY_KEY = [ORG, "item_id", "store_id"]


# ----------------------------------------------------------------- readers

def read_upload_csv(spark: SparkSession, path: str, sample_rows: int | None = None) -> DataFrame:
    """Permissive CSV read, every column as text (coercion happens in B04);
    ``sample_rows`` limits the validation profile to the first rows (reference: 10,000)."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    return df.limit(sample_rows) if sample_rows else df


def read_rows_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Bulk JSON rows (one object per line). With a ``schema`` the files are read once; without, a pass
    over them infers it. A line that is no JSON, and a value that does not fit, give NULLs."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def _typed(df: DataFrame, kinds) -> DataFrame:
    """A text frame with the columns that ``kinds(name)`` gives a type for converted;
    unreadable values become NULL. Reading as text needs no pass to infer types."""
    return df.select(*[F.trim(c).try_cast(kinds(c)).alias(c) if kinds(c) else F.col(c) for c in df.columns])


def _text_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_wide_sales(spark: SparkSession, path: str, store_ids: list[str] | None = None) -> DataFrame:
    """Wide sales CSV (``item_id, dept_id, cat_id, store_id, state_id, d_1 … d_N``),
    optionally only some stores (the filter is pushed to the scan)."""
    df = _text_csv(spark, path)
    df = df.filter(F.col("store_id").isin(store_ids)) if store_ids else df
    return _typed(df, lambda c: "double" if c.startswith("d_") else None)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar CSV."""
    whole = {"wm_yr_wk", "wday", "month", "year", "snap_CA", "snap_TX", "snap_WI"}
    return _typed(_text_csv(spark, path), lambda c: "int" if c in whole else None)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Weekly price CSV."""
    return _typed(_text_csv(spark, path), {"wm_yr_wk": "int", "sell_price": "double"}.get)


# ------------------------------------------------------------- B01 - B08

def resolve_aliases(df: DataFrame) -> DataFrame:
    """Rename accepted column names (any case) to canonical names; the first
    matching column wins when several aliases are present."""
    mapping = {}
    taken = set()
    for c in df.columns:
        low = c.lower()
        for canon, names in ALIASES:
            if low in names and canon not in taken:
                mapping[c] = canon
                taken.add(canon)
                break
    return df.withColumnsRenamed(mapping) if mapping else df


def parse_date(c: Column) -> Column:
    """Lenient date parse (ISO date or timestamp text, or a date/timestamp value); bad -> NULL."""
    s = c.cast("string")
    return F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.to_date(F.try_to_timestamp(s)),
                      F.try_to_date(s, "MM/dd/yyyy"), F.try_to_date(s, "dd-MM-yyyy"))


def parse_number(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def validate_upload(df: DataFrame) -> DataFrame:
    """One-row profile of an upload: presence of canonical columns, bad
    dates, non-numeric sales, range and sales stats (2 dp) and warning flags."""
    d = resolve_aliases(df)
    has = {c: c in d.columns for c in ("date", "sales", "item_id", "store_id", "sell_price")}
    aggs = [F.count(F.lit(1)).alias("rows")]
    if has["date"]:
        pd_ = parse_date(F.col("date"))
        aggs += [F.count(F.when(pd_.isNull(), 1)).alias("bad_dates"), F.min(pd_).alias("min_date"),
                 F.max(pd_).alias("max_date")]
    if has["sales"]:
        n = parse_number(F.col("sales"))
        aggs += [F.count(F.when(n.isNull() & F.col("sales").isNotNull(), 1)).alias("non_numeric_sales"),
                 rnd(F.sum(n), 2).alias("sales_sum"), rnd(F.avg(n), 2).alias("sales_mean"),
                 rnd(F.min(n), 2).alias("sales_min"), rnd(F.max(n), 2).alias("sales_max"),
                 rnd(F.stddev_samp(n), 2).alias("sales_std"),
                 F.count(F.when(n < 0, 1)).alias("negative_sales"),
                 F.count(F.when(F.col("sales").isNull(), 1)).alias("missing_sales")]
    out = d.agg(*aggs)
    out = out.withColumns({f"has_{k}": F.lit(v) for k, v in has.items()})
    ok = F.lit(has["date"] and has["sales"])
    if has["sales"]:
        ok = ok & (F.col("non_numeric_sales") < F.col("rows"))
    return out.withColumn("is_valid", ok).withColumn(
        "warnings", F.filter(F.array(
            F.when(~F.lit(has["item_id"]), F.lit("no item column: default item used")),
            F.when(~F.lit(has["store_id"]), F.lit("no store column: default store used")),
            *([F.when(F.col("negative_sales") > 0, F.lit("negative sales present")),
               F.when(F.col("missing_sales") / F.col("rows") * 100 > 0,
                      F.format_string("%.1f%% missing sales", F.col("missing_sales") / F.col("rows") * 100))]
              if has["sales"] else [])), lambda x: x.isNotNull()))


def coerce(df: DataFrame) -> DataFrame:
    """Defaults for item / store, lenient parse, sales NULL -> 0
    and clipped at 0, price NULL -> 0, rows without a date dropped."""
    d = resolve_aliases(df)
    if "item_id" not in d.columns:
        d = d.withColumn("item_id", F.lit(DEFAULT_ITEM))
    if "store_id" not in d.columns:
        d = d.withColumn("store_id", F.lit(DEFAULT_STORE))
    cols = {"date": parse_date(F.col("date")),
            "sales": F.greatest(F.coalesce(parse_number(F.col("sales")), F.lit(0.0)), F.lit(0.0)),
            "item_id": F.col("item_id").cast("string"), "store_id": F.col("store_id").cast("string")}
    if "sell_price" in d.columns:
        cols["sell_price"] = F.coalesce(parse_number(F.col("sell_price")), F.lit(0.0))
    if "current_stock" in d.columns:
        cols["current_stock"] = parse_number(F.col("current_stock"))
    return d.withColumns(cols).dropna(subset=["date"])


def dedupe_first(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """Keep the first row of each key by input order (``dropDuplicates``
    keeps an arbitrary one)."""
    order = [order] if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_position(df: DataFrame, name: str = "_pos") -> DataFrame:
    """Input position of each row (monotone in file / partition order)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def clean_batch(df: DataFrame, organization_id, order: str | list[str] = "_pos", keep_order: bool = False) -> DataFrame:
    """B01-B08 as one projection: canonical rows of a batch for one tenant (or a
    tenant column), first occurrence per (date, item, store), skip rule,
    revenue. ``keep_order`` keeps the columns of the input order."""
    d = df if (order != "_pos" or "_pos" in df.columns) else with_position(df)
    has_price = any(c.lower() in PRICE_ALIASES for c in d.columns)
    c = coerce(d)
    org = F.col(organization_id) if organization_id in c.columns else F.lit(organization_id)
    c = c.withColumn(ORG, org)
    c = dedupe_first(c, [ORG, "date", "item_id", "store_id"], order)
    if not has_price:
        c = c.filter(F.col("sales") != 0)  # B07: zero rows without any price are skipped
    price = F.col("sell_price") if has_price else F.lit(None).cast("double")
    c = c.withColumn("sell_price", price)
    c = c.withColumn("revenue", F.col("sales") * F.coalesce(F.col("sell_price"), F.lit(0.0)))  # B08
    keep = [ORG, "date", "item_id", "store_id", "sales", "sell_price", "revenue"]
    keep += [x for x in ("category", "current_stock", "name") if x in c.columns]
    keep += [x for x in ([order] if isinstance(order, str) else order) if keep_order and x in c.columns and x not in keep]
    return c.select(*keep)


def auto_clean(df: DataFrame) -> DataFrame:
    """The upload clean-up step on its own (no tenant): canonical names,
    defaults, parse, clip, de-duplicate on (date, item, store)."""
    d = with_position(df)
    c = coerce(d)
    return dedupe_first(c, ["date", "item_id", "store_id"], "_pos").drop("_pos")


def clean_calendar(cal: DataFrame) -> DataFrame:
    """Parse date, trim ``d``, numeric week id, NULL event fields -> 'None'."""
    ev = [c for c in ("event_name_1", "event_type_1", "event_name_2", "event_type_2") if c in cal.columns]
    out = cal.withColumn("date", parse_date(F.col("date")))
    if "d" in cal.columns:
        out = out.withColumn("d", F.trim("d"))
    if "wm_yr_wk" in cal.columns:
        out = out.withColumn("wm_yr_wk", F.col("wm_yr_wk").cast("string").try_cast("int"))
    return out.fillna("None", subset=ev) if ev else out


def melt_sales(wide: DataFrame) -> DataFrame:
    """Wide ``d_*`` day columns -> long ``(ids…, d, sales)``; pass through when
    there is no ``d_1`` column."""
    if "d_1" not in wide.columns:
        return wide
    days = [c for c in wide.columns if c.startswith("d_") and c[2:].isdigit()]
    ids = [c for c in wide.columns if c not in set(days)]
    return wide.unpivot(ids, days, "d", "sales")


def merge_sales(long: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Long sales ⟕ calendar on ``d`` ⟕ weekly prices on (store, item, week),
    then types cleaned. Calendar is small (one row per day); prices are joined
    by key (the planner broadcasts or shuffles by measured size)."""
    j = long.join(calendar, "d", "left").join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")
    return j.withColumns({"date": F.to_date("date"), "sales": F.col("sales").cast("double"),
                          "sell_price": F.col("sell_price").cast("double")})


def build_base(wide: DataFrame, calendar: DataFrame, prices: DataFrame, store_ids: list[str] | None = None) -> DataFrame:
    """Raw wide files -> base long frame: store filter, melt, positional
    calendar key ``d_(row+1)`` when the calendar has none, joins, drop sales ≤ 0."""
    w = wide.filter(F.col("store_id").isin(store_ids)) if store_ids else wide
    cal = clean_calendar(calendar)
    if "d" not in cal.columns:
        cal = cal.withColumn("d", F.concat(F.lit("d_"), F.row_number().over(Window.orderBy("date")).cast("string")))
    out = merge_sales(melt_sales(w), cal, prices)
    return out.filter(F.col("sales") > 0)


def fill_and_drop(df: DataFrame, fill: bool = True) -> DataFrame:
    """NULL -> 0 on numeric columns, or drop rows with any NULL."""
    return df.na.fill(0) if fill else df.na.drop()


def encode_ids(df: DataFrame, cols: list[str]) -> DataFrame:
    """String ids -> integer indices ``<col>_idx`` by falling frequency, ties by id; NULL gets the index after
    the last. Labels are ranked where they are (``split_rank``): none pass through the driver."""
    out = df
    for c in cols:
        labels = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        index = split_rank(labels, [], [F.desc("_n"), c], "_place")
        n = index.agg(F.max("_place")).first()[0] or 0
        named = index.select(F.col(c).alias("_label"), (F.col("_place") - 1).cast("double").alias(f"{c}_idx"))
        out = out.join(named, F.col(c) == F.col("_label"), "left").drop("_label").withColumn(f"{c}_idx", F.coalesce(f"{c}_idx", F.lit(float(n))))
    return out


def sample_series(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Keep ``n`` series per tenant chosen by a seeded hash order
    (repeatable), restricted with a semi join. Off unless asked for."""
    s = df.select(ORG, "item_id", "store_id").distinct()
    w = Window.partitionBy(ORG).orderBy(F.xxhash64(F.lit(seed), "item_id", "store_id"), "item_id", "store_id")
    keep = s.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return df.join(keep, [ORG, "item_id", "store_id"], "left_semi")


def sample_n_rows(df: DataFrame, n: int, seed: int = 42, keys=(ORG, "item_id", "store_id", "date")) -> DataFrame:
    """B19 by count: exactly ``n`` rows of each tenant (all, if fewer), those with the smallest seeded hashes of their
    keys, ties by key. Ranked by parts (``split_rank``), so no tenant's rows meet in one task."""
    ranked = split_rank(df.withColumn("_h", F.xxhash64(F.lit(seed), *keys)), [ORG], ["_h", *keys], "_place")
    return ranked.where(F.col("_place") <= n).drop("_h", "_place")


def sample_rows(df: DataFrame, fraction: float, seed: int = 42, keys=(ORG, "item_id", "store_id", "date")) -> DataFrame:
    """Repeatable row sample by a seeded hash of the row key."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(fraction * 1_000_000))


# ----------------------------------------------------------- upsert

def merge_by_key(existing: DataFrame | None, batch: DataFrame, keys: list[str]) -> DataFrame:
    """A08 / A09 core: union old and new rows, keep the newest per key (batch
    rows win). Pure DataFrame; callers write the result."""
    b = batch.withColumn("_src", F.lit(1))
    if existing is None:
        u = b
    else:
        u = existing.select(*batch.columns).withColumn("_src", F.lit(0)).unionByName(b)
    w = Window.partitionBy(*keys).orderBy(F.desc("_src"))
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_src")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, keys: list[str],
                 partition_cols: list[str] | None = None) -> DataFrame:
    """Idempotent keyed upsert into a Parquet table.

    Dated rows are partitioned by tenant and month (year * 100 + month of
    ``date`` / ``day``), others by tenant. Only the partitions that the batch
    touches are read (the semi join on the partition columns prunes them) and
    rewritten (dynamic partition overwrite): a late row costs one month. The
    merged rows are staged under the shared checkpoint folder first; re-running
    the same batch gives the same table.
    """
    dated = next((c for c in ("date", "day") if c in keys), None)
    if dated:
        batch = batch.withColumn("month", F.year(dated) * 100 + F.month(dated))
    parts = partition_cols or [c for c in (ORG, "month") if c in batch.columns]
    touched = batch.select(*parts).distinct()
    if _exists(spark, path):
        old = spark.read.parquet(path).join(touched, parts, "left_semi")
        merged = merge_by_key(old, batch, keys)
    else:
        merged = merge_by_key(None, batch, keys)
    stage = scratch_path(spark, f"stage-{uuid.uuid4().hex}")
    merged.write.mode("overwrite").parquet(stage)
    staged = spark.read.schema(merged.schema).parquet(stage)
    # few files for each partition; a large partition is split
    (staged.select(*batch.columns).hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(*parts).parquet(path))
    _delete(spark, stage)
    return spark.read.parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a staged copy once its table is written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _first_each(candidates: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """One candidate per key: the first in input order (without the order columns)."""
    if not order:
        return candidates.dropDuplicates(keys)
    return dedupe_first(candidates, keys, order).drop(*order)


def new_dimension_rows(existing: DataFrame | None, candidates: DataFrame, keys: list[str],
                       order: list[str] | None = None) -> DataFrame:
    """Keys not yet in the dimension (``left_anti``)."""
    c = _first_each(candidates, keys, order)
    return c if existing is None else c.join(existing.select(*keys), keys, "left_anti")


def fill_missing_attributes(existing: DataFrame, candidates: DataFrame, keys: list[str],
                            attrs: list[str], order: list[str] | None = None) -> DataFrame:
    """A10: for existing keys, fill only attributes that are missing (old wins)."""
    c = _first_each(candidates, keys, order).select(*keys, *[F.col(a).alias(f"_n_{a}") for a in attrs])
    j = existing.join(c, keys, "left")
    return j.withColumns({a: F.coalesce(F.col(a), F.col(f"_n_{a}")) for a in attrs}).drop(
        *[f"_n_{a}" for a in attrs])


def product_rows(clean: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Product dimension candidates from a clean batch: sku, name, category, unit price
    (and the columns of the input order)."""
    cols = [ORG, "item_id",
            (F.col("name") if "name" in clean.columns else F.col("item_id")).alias("name"),
            (F.col("category") if "category" in clean.columns else F.lit(None).cast("string")).alias("category"),
            F.col("sell_price").alias("unit_price"), F.lit(None).cast("double").alias("unit_cost")]
    return clean.select(*cols, *(order or []))


def upsert_dimension(existing: DataFrame | None, candidates: DataFrame, keys: list[str],
                     attrs: list[str], order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new dimension content, newly created rows); of several
    candidates for a key the first in input order counts."""
    created = new_dimension_rows(existing, candidates, keys, order)
    if existing is None:
        return created, created
    return fill_missing_attributes(existing, candidates, keys, attrs, order).unionByName(
        created.select(*existing.columns)), created


def ingest(spark: SparkSession, root: str, df: DataFrame, organization_id, source_type: str = "csv",
           job_id: str | None = None, order: str | list[str] = "_pos") -> dict:
    """Alias -> defaults -> coerce -> drop NULL dates -> dedupe -> dimensions
    -> sales upsert -> inventory upsert -> counts, plus the A12 job row.

    Tables live under ``root``: ``sales``, ``products``, ``stores``,
    ``inventory_levels``, ``import_jobs``. Counts come from the staged frames.
    """
    job_id = job_id or uuid.uuid4().hex
    received = df.count()
    by = [order] if isinstance(order, str) else list(order)
    clean = clean_batch(df, organization_id, order, keep_order=True).cache()
    imported = clean.count()
    prod_path, store_path = f"{root}/products", f"{root}/stores"
    old_p = spark.read.parquet(prod_path) if _exists(spark, prod_path) else None
    old_s = spark.read.parquet(store_path) if _exists(spark, store_path) else None
    prods, new_p = upsert_dimension(old_p, product_rows(clean, by), [ORG, "item_id"], ["category", "unit_price"], by)
    stores, new_s = upsert_dimension(old_s, clean.select(ORG, "store_id", *by), [ORG, "store_id"], [], by)
    n_new_p, n_new_s = new_p.count(), new_s.count()
    batch = clean.select(ORG, "item_id", "store_id", "date", "sales", "revenue",
                         F.lit(job_id).alias("batch_id"), F.current_timestamp().alias("ingested_at"))
    upsert_table(spark, f"{root}/sales", batch, SALES_KEY)
    upsert_table(spark, prod_path, prods, [ORG, "item_id"])
    upsert_table(spark, store_path, stores, [ORG, "store_id"])
    if "current_stock" in clean.columns:
        inv = clean.filter(F.col("current_stock").isNotNull()).select(
            ORG, "item_id", "store_id", F.col("current_stock").alias("quantity_on_hand"),
            F.current_date().alias("snapshot_date"), *by)
        # rows are written in input order, so a key's last one stays
        inv = dedupe_first(inv, INVENTORY_KEY, [F.desc(c) for c in by]).drop(*by)
        upsert_table(spark, f"{root}/inventory_levels", inv, INVENTORY_KEY)
    clean.unpersist()
    job = spark.createDataFrame(
        [(job_id, str(organization_id), source_type, "succeeded", received, imported)],
        "job_id string, organization_id string, source_type string, status string, rows_received long, "
        "rows_imported long").withColumn("finished_at", F.current_timestamp())
    job.write.mode("append").parquet(f"{root}/import_jobs")  # A12
    return {"job_id": job_id, "rows_received": received, "rows_imported": imported,
            "products": n_new_p, "stores": n_new_s}


def load_sales(spark: SparkSession, root: str, start=None, end=None, organization_id=None) -> DataFrame:
    """A06 / C01 / B17 over ingested tables: sales ⋈ products, optional tenant and inclusive date range filters,
    ``sell_price = revenue / quantity`` (NULL when quantity is 0)."""
    s = spark.read.parquet(f"{root}/sales")
    if organization_id is not None:
        s = s.filter(F.col(ORG) == organization_id)
    if start is not None:
        s = s.filter(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        s = s.filter(F.col("date") <= F.to_date(F.lit(end)))
    p = spark.read.parquet(f"{root}/products").select(ORG, "item_id", "category")
    return s.join(p, [ORG, "item_id"], "left").select(
        ORG, "item_id", "store_id", "date", "sales", F.try_divide("revenue", "sales").alias("sell_price"), "category")


def load_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Inventory levels as ``current_stock`` per series."""
    return spark.read.parquet(f"{root}/inventory_levels").select(
        ORG, "item_id", "store_id", F.col("quantity_on_hand").alias("current_stock"))


def table_summary(sales: DataFrame) -> DataFrame:
    """Products, stores, sales rows, first / last date, days covered per tenant."""
    return sales.groupBy(ORG).agg(
        F.countDistinct("item_id").alias("products"), F.countDistinct("store_id").alias("stores"),
        F.count(F.lit(1)).alias("sales_rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date")
    ).withColumn("days_covered", F.datediff("max_date", "min_date").cast("bigint"))


# ------------------------------------------------------------ sinks

def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with header (cleaned upload, forecast / inventory / decision reports)."""
    (df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).csv(path))


# Fixed values that must equal the reference's: the columns of a report's decisions.
REPORT_DECISION_COLUMNS = ["item_id", "store_id", "recommended_order_qty", "order_date", "arrival_date", "status",
                           "days_of_stock", "stockout_date", "unit_price", "inventory_value", "overstock_capital",
                           "stockout_revenue_loss", "potential_savings"]


def write_decision_report(decisions: DataFrame, path: str) -> None:
    """The decision report as CSV, its columns in their order. ``decisions``: purchase decisions (H11), with or
    without a rank; one folder of part files per tenant, rows of a part by falling order quantity."""
    extra = [c for c in REPORT_DECISION_COLUMNS if c not in decisions.columns]
    if extra:
        raise ValueError(f"missing report columns: {extra}")
    rows = decisions.select(ORG, *REPORT_DECISION_COLUMNS).sortWithinPartitions(ORG, F.desc("recommended_order_qty"), "item_id", "store_id")
    rows.write.mode("overwrite").option("header", True).partitionBy(ORG).csv(path)


def record_dataset(spark: SparkSession, root: str, organization_id: str, user: str, filename: str, status: str,
                   rows: int, error: str | None = None) -> None:
    """Append a dataset catalogue row (success or error)."""
    spark.createDataFrame([(uuid.uuid4().hex, organization_id, user, filename, status, rows, error)],
                          "dataset_id string, organization_id string, user_id string, filename string, "
                          "status string, rows long, error string") \
         .withColumn("uploaded_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/datasets")


def upload_history(datasets: DataFrame, user: str, limit: int | None = None) -> DataFrame:
    """A user's uploads, newest first; the first ``limit`` if given."""
    out = datasets.filter(F.col("user_id") == user).orderBy(F.desc("uploaded_at"), "dataset_id")
    return out if limit is None else out.limit(limit)


def materialize_aggregates(fact: DataFrame, root: str) -> None:
    """Daily-by-store and product-total tables plus a one-row meta table."""
    from tillsight.operators import dashboards as D
    D.daily_store(fact).write.mode("overwrite").partitionBy(ORG).parquet(f"{root}/agg_daily_store")
    D.product_totals(fact).write.mode("overwrite").partitionBy(ORG).parquet(f"{root}/agg_product_totals")
    meta = fact.groupBy(ORG).agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("min_date"),
                                 F.max("date").alias("max_date"),
                                 F.countDistinct("item_id", "store_id").alias("n_series"))
    meta.withColumn("generated_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{root}/agg_meta")
