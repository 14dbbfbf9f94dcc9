"""tillsight — retail sales, demand and inventory analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` over the canonical sales
fact (``organization_id, item_id, store_id, date, sales, sell_price, category``).
All grouping keys carry ``organization_id`` so one job serves every tenant, and
every time-relative operator takes an explicit ``as_of`` (``None`` = the tenant's
latest sales date).
"""

from tillsight.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
