"""Named queries over the given tables; importing this package registers them all."""

from tillsight.plans.catalog import REGISTRY, Query  # noqa: F401
from tillsight.plans import dashboards, calendar, features, inventory, health, insights, models  # noqa: F401
from tillsight.plans import ingest, lifecycle, more, streaming  # noqa: F401


def all_queries() -> dict:
    return {name: q.build for name, q in REGISTRY.items()}


def all_oracles() -> dict:
    return {name: q.oracle for name, q in REGISTRY.items() if q.oracle}
