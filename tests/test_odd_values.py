"""Queries on element-wise functions against their SQL where values are null, NaN, infinite or zero."""

import math

import oracle
import pytest
from strandline.plans.queries import ORACLE_SQL, QUERIES

VALUES = (None, math.nan, math.inf, -math.inf, 0.0, -0.0, 2.5, -2.5, 29.27)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(100 * k + e, v) for k, v in enumerate(VALUES, -4) for e in range(10)]
    spark.createDataFrame(rows, "event_id long, value double").repartition(1).write.parquet(f"{at}/events.parquet")
    return at


@pytest.fixture(scope="module")
def con(odd):
    con = oracle.duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{odd}/events.parquet/*.parquet')")
    return con


def test_math_division(spark, odd, con):
    columns, got = oracle.from_spark(QUERIES["math_division"](spark, odd))
    assert (columns, got) == oracle.from_sql(con, ORACLE_SQL["math_division"])
    assert len(got) == 90 and sum(r[1] == "nan" for r in got) == 2 + 8 + 2 * 2  # event_id, f, i: nulls over zero, NaN over others, zeros over zero


def test_math_exp_log(spark, odd, con):
    columns, got = oracle.from_spark(QUERIES["math_exp_log"](spark, odd))
    assert (columns, got) == oracle.from_sql(con, ORACLE_SQL["math_exp_log"])
    ln = [r[columns.index("ln")] for r in got]
    assert len(got) == 90 and ln.count("nan") == 10 + 10 + 20 and ln.count(-math.inf) == 20  # nulls, NaN, negative values; zeros
