"""Apply shapes, groups, exact quantiles, buckets of open days, zones in SQL and index columns."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from strandline.calendars.busday import BusinessDays, CBDay
from strandline.frame import Frame
from strandline.functions.offsets import WeekOfMonth, bday
from strandline.operators import aggregate, combine
from strandline.operators.resample import Resample, bucket
from strandline.plans.sql import query, zoned
from strandline.sources import files


@pytest.fixture(scope="module")
def f(spark):
    rows = [(0, "b", 1.0), (1, "a", 2.0), (2, "b", 4.0), (3, None, 8.0), (4, "a", None)]
    return Frame(spark.createDataFrame(rows, "i int, k string, v double"), "i")


def test_apply_shapes(f):
    g = f.group_by("k")
    assert {r.k: r.out for r in g.apply(lambda p: float(p.v.sum()), "out double", "scalar").collect()} == {"b": 5.0, "a": 2.0, None: 8.0}
    assert {(r.k, r.n, r.top) for r in g.apply(lambda p: {"n": len(p), "top": p.v.max()}, "n int, top double", "row").collect()} == {("b", 2, 4.0), ("a", 2, 2.0), (None, 1, 8.0)}
    assert {(r.k, r.pos, r.s) for r in g.apply(lambda p: p.v.fillna(0).cumsum(), "s double", "series").collect()} == {("b", 0, 1.0), ("b", 1, 5.0), ("a", 0, 2.0), ("a", 1, 2.0), (None, 0, 8.0)}
    assert g.apply(lambda p: p[["v"]].head(1), "v double", "rows", group_keys=False).columns == ["v"]
    with pytest.raises(ValueError):
        g.apply(len, "n int", "other")


def test_groups(f):
    got = sorted((r.pos, r.k, r.group) for r in f.group_by("k").groups().collect())
    assert got == [(0, "b", 0), (1, "a", 1), (2, "b", 0), (3, None, 2), (4, "a", 1)]


def test_group_by_expression(f):
    out = f.group_by(F.col("i") % 2).agg("sum", columns=["v"]).collect()
    assert [(r["__groupby_key_0__"], r.v) for r in out] == [(0, 5.0), (1, 10.0)]


@pytest.mark.parametrize("how", ["linear", "lower", "higher", "nearest", "midpoint"])
def test_quantiles(spark, how):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": rng.integers(0, 4, 300), "v": rng.integers(0, 40, 300).astype(float)})
    df = spark.createDataFrame(data).unionAll(spark.createDataFrame([(9, None)], "k long, v double"))
    got = {r.k: r.v for r in aggregate.quantiles(df, "v", 0.37, ["k"], how).collect()}
    assert got == pytest.approx({k: np.quantile(p.v, 0.37, method=how) for k, p in data.groupby("k")})
    assert Frame(df, "k").quantile("v", 0.9, how).first()[0] == pytest.approx(np.quantile(data.v, 0.9, method=how))
    assert aggregate.quantiles(df.where("k = 9"), "v", 0.5, interpolation=how).first()[0] is None


def test_rolling_apply_frame(f):
    make = lambda p: {"n": len(p), "s": p.i.iloc[-1] - p.i.iloc[0]}
    out = f.rolling_apply_frame(make, ["i"], 3, "n int, s int", min_periods=2).df.orderBy("i").collect()
    assert [r.applied and (r.applied.n, r.applied.s) for r in out] == [None, (2, 1), (3, 2), (3, 2), (3, 2)]


@pytest.mark.parametrize("closed", ["left", "right"])
@pytest.mark.parametrize("label", ["left", "right"])
@pytest.mark.parametrize(("mine", "theirs"), [(bday(1), "B"), (bday(3), "3B"), (WeekOfMonth(1, 2, 4), "WOM-3FRI"), (WeekOfMonth(2, 0, 0), "2WOM-1MON"), (CBDay(1, BusinessDays("1111100", (dt.date(2024, 1, 1), dt.date(2024, 1, 15)))), None)])
def test_open_day_buckets(spark, closed, label, mine, theirs):
    times = pd.date_range("2023-12-30 07:00", periods=160, freq="19h").append(pd.DatetimeIndex(["2024-01-02", "2024-01-19", "2024-02-05"]))
    freq = theirs or pd.offsets.CustomBusinessDay(holidays=["2024-01-01", "2024-01-15"])
    theirs = pd.Series(1, times).sort_index().resample(freq, closed=closed, label=label).sum()
    df = spark.createDataFrame(pd.DataFrame({"t": times})).select(F.col("t").cast("timestamp_ntz"))
    got = df.groupBy(bucket(df, "t", Resample(mine, closed=closed, label=label)).alias("t")).count().collect()
    assert {r["t"]: r["count"] for r in got} == {k.to_pydatetime(): v for k, v in theirs[theirs > 0].items()}


def test_zones_in_sql(spark):
    df = spark.sql("select timestamp_ntz'2024-07-01 12:00:00' as w, timestamp'2024-01-01 12:00:00' as t, 'x AT TIME ZONE y' as s")
    out = query(df, "SELECT t AT TIME ZONE 'America/New_York' AS a, (w) at time zone 'America/New_York' AS b, EXTRACT(TIMEZONE FROM date_trunc('day', t)) AS z, 'q AT TIME ZONE r' AS s FROM self").first()
    assert out.a == dt.datetime(2024, 1, 1, 7) and out.z == 0 and out.s == "q AT TIME ZONE r"
    assert out.b.astimezone(dt.UTC) == dt.datetime(2024, 7, 1, 16, tzinfo=dt.UTC)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert query(df, "SELECT EXTRACT(TIMEZONE FROM t) AS z, extract(timezone from w) AS y FROM self").first()[:] == (-18000, -14400)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert zoned(df, "SELECT 1") == "SELECT 1"


def test_index_columns(spark, tmp_path, f):
    path = str(tmp_path / "t")
    files.write_parquet(files.with_index(f, index_label="row"), path)
    back = files.indexed(files.read_parquet(spark, path), "row")
    assert back.index == ["row"] and back.columns == ["k", "v"] and back.df.count() == 5
    assert files.with_index(f, include_index=False).columns == ["k", "v"]
    with pytest.warns(UserWarning):
        assert files.indexed(f.df, "nothing").index == []


def test_ignore_index_and_first_seen(spark, f):
    out = combine.concat_rows([f.df, f.df.where("i < 2").withColumn("i", F.col("i").cast("long"))], ignore_index="i").orderBy("i").collect()
    assert [(r.i, r.v) for r in out] == [(0, 1.0), (1, 2.0), (2, 4.0), (3, 8.0), (4, None), (5, 1.0), (6, 2.0)]
    a, b = spark.createDataFrame([(1, "z"), (2, "a"), (3, "z")], "o int, k string"), spark.createDataFrame([(1, "m"), (2, "a"), (3, "b")], "o int, k string")
    assert [r.k for r in combine.label_union(a, b, "k", ["o"]).collect()] == ["z", "a", "m", "b"]
