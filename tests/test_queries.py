"""Every registered query against DuckDB on the smallest tables."""

import oracle
import pytest
from strandline.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    columns, got = oracle.from_spark(QUERIES[name](spark, sf))
    assert got or name in ORACLE_SQL  # a small table may leave nothing
    if name in ORACLE_SQL:
        assert (columns, got) == oracle.from_sql(con, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
