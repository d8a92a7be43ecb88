"""Each query over the tables against its SQL."""

import pytest
from conftest import SF, same_rows

from brindle.plans import tables


@pytest.mark.parametrize("name", sorted(tables.QUERIES))
def test_query_matches_sql(spark, duck, name):
    same_rows(tables.QUERIES[name](spark, SF), duck, tables.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(tables.QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["symbol_id", "crate_name", "name", "visibility"]
