"""Every registered query with an oracle matches DuckDB on the sf0.001 tables."""

import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E
from tillsight.plans.compare import difference

SLOW = set()
ORACLES = E.oracle_sql()
NAMES = sorted(n for n in E.queries() if n in ORACLES and n not in SLOW)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    spd = E.queries()[name](spark, SF_SMALL).toPandas()
    opd = duck.execute(ORACLES[name]).fetchdf()
    assert difference(spd, opd) is None, difference(spd, opd)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["organization_id", "date", "sales"]
    assert df.count() > 0


def test_every_query_has_a_doc():
    from tillsight.plans import REGISTRY
    assert all(q.doc for q in REGISTRY.values())
