"""Scans of the given parquet tables and the canonical sales fact built from them.

The canonical fact has one row per ``(organization_id, item_id, store_id, date)``:

====================  =====================================================
organization_id       tenant key (region name in the test tables)
store_id              nation name of the supplier
item_id               ``p_brand || '/' || p_type``
category              ``p_type``
date                  ``cast(l_shipdate as date)``
sales                 ``sum(l_quantity)``
sell_price            ``sum(l_extendedprice) / sum(l_quantity)`` (NULL when 0)
====================  =====================================================

Scale notes: the lineitem scan reads six columns only (ReadSchema is pruned by
Catalyst). Region and nation are fixed-size (5 and 25 rows) and broadcast;
part and supplier grow with the scale factor, so they are broadcast only
after a row count proves them small (``checked_broadcast``) — beyond the bound
the planner shuffles lineitem by the join key instead. The final aggregate is
a partial + final hash aggregate, so each task pre-aggregates its rows before
the shuffle; a table of more rows than the shuffle partitions should hold is dealt by the
fact's keys over more parts first (``dealt``), which bounds what a task groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.core import checked_broadcast, dealt

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

FACT_KEYS = ("organization_id", "item_id", "store_id")
SERIES_KEYS = FACT_KEYS


_SCANS: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one given (read-only) table. The relation is built once per
    session and path: its schema comes from the file footer, which Spark reads
    with a job, and equal scans let the planner reuse exchanges."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    df = _SCANS.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _SCANS[key] = df
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread the rows over the cluster's cores by a high-cardinality key
    when the scan yields fewer input partitions than cores (e.g. a file with a
    single row group). Large inputs already have at least as many splits as
    cores and pass unchanged, so no extra shuffle is added at scale. (Hash
    rather than round-robin: round-robin must sort rows first to stay
    deterministic under task retries.)"""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _line_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem ⋈ part ⋈ supplier ⋈ nation ⋈ region with canonical key names
    (A03: a column-pruned scan — only the six needed lineitem columns are read)."""
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"), "l_orderkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 x 5 rows
    geo = (supp.join(F.broadcast(places), supp.s_nationkey == places.n_nationkey)
               .select("s_suppkey", F.col("r_name").alias("organization_id"),
                       F.col("n_name").alias("store_id")))
    # part / supplier grow with the data: broadcast only below a counted bound,
    # else the planner shuffles lineitem by the join key.
    base = (sf_dir.rstrip("/"), _source_version(spark, sf_dir))  # a grown table is counted again
    return (li.join(checked_broadcast(part, key=(base, "part")), li.l_partkey == part.p_partkey)
              .join(checked_broadcast(geo, key=(base, "supplier")), li.l_suppkey == geo.s_suppkey)
              .select("organization_id", "store_id",
                      F.concat_ws("/", "p_brand", "p_type").alias("item_id"),
                      F.col("p_type").alias("category"),
                      F.to_date("l_shipdate").alias("date"),
                      "l_orderkey", "l_quantity", "l_extendedprice"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the session's shared checkpoint folder and
    return the stored table.

    Used where one derived frame feeds several branches of a plan: column
    pruning makes each branch's copy of the upstream aggregate differ, so Spark
    would re-derive it (re-scanning lineitem) per branch. The stored table cuts
    that lineage once, survives executor loss, and gives the planner real file
    sizes for its join decisions.
    """
    return materialize_at(df, name)[1]


def materialize_at(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """``materialize``, with the stored table's path."""
    import uuid

    from tillsight.session import scratch_path
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return path, df.sparkSession.read.parquet(path)


_STORED: dict = {}
FACT_SOURCES = ("lineitem", "part", "supplier", "nation", "region")


def _source_version(spark: SparkSession, sf_dir: str) -> tuple:
    """Modification times of the fact's source files (Hadoop FS API, so it
    works for any cluster file system)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for name in FACT_SOURCES:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        out.append(p.getFileSystem(conf).getFileStatus(p).getModificationTime())
    return tuple(out)


class SalesTables:
    """The canonical tables derived from the given tables.

    ``fact`` is derived once (lineitem scanned once) and stored as a Parquet
    table in the shared checkpoint folder — the counterpart of the ingested,
    tenant-keyed ``sales`` table a deployment queries. Within a session the
    stored table is reused while its source files are unchanged (keyed by
    their modification times), as a deployment reuses its sales table;
    ``stock`` is an aggregate of the stored fact (sums are associative), not a
    second scan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = True):
        self.spark, self.sf_dir, self.stored = spark, sf_dir, stored
        self._wide = None

    def _fact_wide(self) -> DataFrame:
        if self._wide is None and self.stored:
            key = (id(self.spark), self.sf_dir.rstrip("/"), _source_version(self.spark, self.sf_dir))
            path = _STORED.get(key)
            if path is not None:
                try:
                    self._wide = self.spark.read.parquet(path)
                except Exception:  # noqa: BLE001 — stored copy gone: derive again
                    _STORED.pop(key, None)
        if self._wide is None:
            lines = dealt(_line_dims(self.spark, self.sf_dir), [*FACT_KEYS, "date"], read_table(self.spark, self.sf_dir, "lineitem").count())
            w = (lines.groupBy("organization_id", "item_id", "store_id", "category", "date")
                      .agg(F.sum("l_quantity").alias("sales"),
                           F.sum("l_extendedprice").alias("_revenue"),
                           F.sum("l_orderkey").alias("_orderkey_sum"))
                      .select("organization_id", "item_id", "store_id", "category", "date", "sales",
                              F.try_divide("_revenue", "sales").alias("sell_price"), "_orderkey_sum"))
            if self.stored:
                self._wide_path, self._wide = materialize_at(w, "fact")
                _STORED[key] = self._wide_path
            else:
                self._wide = w
        return self._wide

    def fact(self) -> DataFrame:
        """The tenant sales frame (all tenants) in canonical form."""
        return self._fact_wide().drop("_orderkey_sum")

    def stock(self) -> DataFrame:
        """Stock on hand per series: ``pmod(sum(l_orderkey), 4000)`` (no stock table exists)."""
        return (self._fact_wide().groupBy("organization_id", "item_id", "store_id")
                    .agg(F.pmod(F.sum("_orderkey_sum"), F.lit(4000)).cast("double").alias("current_stock")))


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenant sales frame (all tenants) in canonical form, stored once."""
    return SalesTables(spark, sf_dir).fact()


def inventory_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock on hand per series (see ``SalesTables.stock``)."""
    return SalesTables(spark, sf_dir).stock()


def product_dim(spark: SparkSession, sf_dir: str, fact: DataFrame | None = None) -> DataFrame:
    """Products per tenant: name, category, list price as unit price and cost."""
    fact = fact if fact is not None else sales_fact(spark, sf_dir)
    lines = fact.select("organization_id", "item_id").distinct()
    part = read_table(spark, sf_dir, "part")
    items = (part.groupBy(F.concat_ws("/", "p_brand", "p_type").alias("item_id"))
                 .agg(F.min("p_name").alias("name"),
                      F.first("p_type").alias("category"),
                      F.avg("p_retailprice").alias("unit_price"))
                 .withColumn("unit_cost", F.col("unit_price") * 0.7))
    return lines.join(items, "item_id").select(
        "organization_id", "item_id", "name", "category", "unit_price", "unit_cost")


# Oracle (DuckDB) text of the same fact, shared by every oracle statement.
FACT_SQL = """
lines AS (
  SELECT r.r_name AS organization_id, n.n_name AS store_id,
         concat_ws('/', p.p_brand, p.p_type) AS item_id, p.p_type AS category,
         CAST(l.l_shipdate AS DATE) AS date, l.l_orderkey, l.l_quantity, l.l_extendedprice
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
fact AS (
  SELECT organization_id, item_id, store_id, category, date,
         SUM(l_quantity) AS sales,
         SUM(l_extendedprice) / NULLIF(SUM(l_quantity), 0) AS sell_price
  FROM lines GROUP BY organization_id, item_id, store_id, category, date
),
stock AS (
  SELECT organization_id, item_id, store_id,
         CAST(((SUM(l_orderkey) % 4000) + 4000) % 4000 AS DOUBLE) AS current_stock
  FROM lines GROUP BY organization_id, item_id, store_id
)"""
