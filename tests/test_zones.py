"""Sessions and buckets are the same instants whatever the session's zone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from strandline.calendars.market import get_calendar, open_at_time
from strandline.operators import resample


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zoned(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_open_and_close(zoned):
    got = get_calendar("NYSE").schedule(zoned, dt.date(2024, 3, 8), dt.date(2024, 7, 3))
    at = {r["date"]: (r["o"], r["c"]) for r in got.select("date", F.unix_timestamp("open").alias("o"), F.unix_timestamp("close").alias("c")).collect()}
    utc = lambda *x: int(dt.datetime(*x, tzinfo=dt.UTC).timestamp())
    assert at[dt.date(2024, 3, 8)] == (utc(2024, 3, 8, 14, 30), utc(2024, 3, 8, 21))
    assert at[dt.date(2024, 3, 11)] == (utc(2024, 3, 11, 13, 30), utc(2024, 3, 11, 20))
    assert at[dt.date(2024, 7, 3)] == (utc(2024, 7, 3, 13, 30), utc(2024, 7, 3, 17))


def test_open_at(zoned):
    schedule = get_calendar("NYSE").schedule(zoned, dt.date(2024, 3, 8), dt.date(2024, 3, 12))
    times = zoned.createDataFrame([(1709908200,), (1709908199,), (1710163800,), (1710187200,), (1710187199,), (None,), (1710163800,)], "s long").select("s", F.timestamp_seconds("s").alias("t"))
    got = [r["is_open"] for r in open_at_time(times, "t", schedule).collect()]
    assert got == [True, False, True, False, True, False, True]


def test_local_days(zoned):
    df = zoned.createDataFrame([("2024-03-10 04:59:59",), ("2024-03-10 05:00:00",), ("2024-03-11 03:59:59",), ("2024-03-11 04:00:00",)], "x string").select(F.to_timestamp_ntz("x").alias("t"))
    o = resample.Resample("1D", tz="America/New_York")
    got = [r[0] for r in df.select(resample.bucket(df, "t", o)).collect()]
    assert got == [dt.datetime(2024, 3, 9, 5), dt.datetime(2024, 3, 10, 5), dt.datetime(2024, 3, 10, 5), dt.datetime(2024, 3, 11, 4)]
