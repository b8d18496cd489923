"""Every registered query with SQL gives the SQL's rows."""

import pytest

from quantgrove.plans.catalog import QUERIES, SQL
from tests.compare import duck, ordered


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    got, want = ordered(QUERIES[name](spark, sf).toPandas()), ordered(duck(sf, SQL[name]))
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), f"{name}: {len(got)} rows against {len(want)}"
