"""Buckets, offsets, zones and calendars against pandas, NumPy and known dates."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from strandline.calendars import holidays as H
from strandline.calendars.busday import BusinessDays, cbday
from strandline.calendars.market import CALENDARS, get_calendar, merge_schedules, open_at_time
from strandline.functions import offsets as O
from strandline.functions import temporal as T
from strandline.operators import resample as R

D = dt.date


@pytest.fixture(scope="module")
def times(spark):
    rng = np.random.default_rng(1)
    at = np.sort(pd.Timestamp("2023-11-28 22:11:07").value // 1000 + rng.integers(0, 100 * 86_400_000_000, 300))
    at[:3] = [pd.Timestamp(x).value // 1000 for x in ("2023-11-30", "2023-12-31", "2024-01-01")]
    series = pd.Series(1.0, index=pd.DatetimeIndex(np.sort(at) * 1000))
    rows = [(t.to_pydatetime(),) for t in series.index]
    return series, spark.createDataFrame(rows, "ts timestamp_ntz").cache()


def ours(df, o):
    got = R.resample(df, "ts", o).count().collect()
    return {pd.Timestamp(r["ts"]): r["count"] for r in got}


def theirs(series, freq, **kw):
    out = series.resample(freq, **kw).count()
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("origin", ["epoch", "start", "start_day", "end", "end_day", dt.datetime(2023, 5, 5, 5)])
@pytest.mark.parametrize("closed", ["left", "right"])
@pytest.mark.parametrize("label", ["left", "right"])
@pytest.mark.parametrize("minutes", [17, 420])
def test_ticks(times, origin, closed, label, minutes):
    series, df = times
    o = R.Resample(f"{minutes}min", closed, label, origin, dt.timedelta(minutes=3))
    origin = pd.Timestamp(origin) if isinstance(origin, dt.datetime) else origin
    try:
        want = theirs(series, f"{minutes}min", closed=closed, label=label, origin=origin, offset="3min")
    except ValueError as e:
        pytest.skip(f"pandas: {e}")
    assert ours(df, o) == want


@pytest.mark.parametrize("closed", ["left", "right", None])
@pytest.mark.parametrize("label", ["left", "right", None])
@pytest.mark.parametrize("freq", ["ME", "QE", "YE", "W", "MS", "QS", "YS"])
def test_calendar_buckets(times, freq, closed, label):
    series, df = times
    assert ours(df, R.Resample(freq, closed, label)) == theirs(series, freq, closed=closed, label=label)


def test_minute_bars(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1, 0, m), float(m)) for m in range(9)], "ts timestamp_ntz, v double")
    run = lambda **kw: [(r["ts"].minute, r["s"]) for r in R.resample(df, "ts", R.Resample("3min", **kw)).agg(F.sum("v").alias("s")).orderBy("ts").collect()]
    assert run() == [(0, 3), (3, 12), (6, 21)] and run(label="right") == [(3, 3), (6, 12), (9, 21)]
    assert run(closed="right", label="right") == [(0, 0), (3, 6), (6, 15), (9, 15)]


@pytest.mark.parametrize("n", [-7, -2, -1, 1, 2, 8])
@pytest.mark.parametrize("code", ["ME", "MS", "QE", "QS", "YE", "YS", "W", "B", "BME", "BMS"])
def test_offsets(times, code, n):
    series, df = times
    rule = O.parse(code) * n
    make = {"W": lambda: pd.offsets.Week(n, weekday=6), "QE": lambda: pd.offsets.QuarterEnd(n, startingMonth=12), "QS": lambda: pd.offsets.QuarterBegin(n, startingMonth=1), "B": lambda: pd.offsets.BDay(n)}
    them = make[code]() if code in make else pd.tseries.frequencies.to_offset(code) * n
    keep = code in ("W", "B")
    want = [t + them if keep else (t + them).normalize() for t in series.index]
    assert [pd.Timestamp(rule.add(t.to_pydatetime())) for t in series.index] == want
    assert [pd.Timestamp(r[0]) for r in df.select(rule.column(F.col("ts"))).collect()] == want


@pytest.mark.parametrize("rule", [O.week_of_month(1, 2, 4), O.week_of_month(-3, 0, 0), O.last_week_of_month(2, 6), O.Easter(1), O.Easter(-2), O.date_offset(1, months=1, days=-2, hours=5), O.date_offset(-1, years=1)])
def test_column_forms(times, rule):
    series, df = times
    assert [r[0] for r in df.select(rule.column(F.col("ts"))).collect()] == [rule.add(t.to_pydatetime()) for t in series.index]


def test_relative_and_easter():
    assert [O.easter(y) for y in (2019, 2024, 2025)] == [D(2019, 4, 21), D(2024, 3, 31), D(2025, 4, 20)]
    assert O.date_offset(months=1).add(dt.datetime(2024, 1, 31)) == dt.datetime(2024, 2, 29)
    assert O.date_offset(day=1, weekday=(4, 3)).add(dt.datetime(2024, 3, 20)) == dt.datetime(2024, 3, 15)
    assert O.SessionAnchor(delta=dt.timedelta(minutes=30)).on_offset(dt.datetime(2024, 1, 2, 10))


def test_zones(spark):
    day = lambda d, h, m=30: spark.createDataFrame([(dt.datetime(2024, *d, h, m),)], "t timestamp_ntz")
    at = lambda df, **kw: df.select(T.tz_localize(F.col("t"), "America/New_York", **kw).cast("timestamp_ntz")).first()[0]
    overlap, gap = day((11, 3), 1), day((3, 10), 2)
    assert at(overlap, ambiguous="earliest") == dt.datetime(2024, 11, 3, 5, 30) and at(overlap, ambiguous="latest") == dt.datetime(2024, 11, 3, 6, 30)
    assert at(overlap, ambiguous="nat") is None and at(gap, nonexistent="nat") is None
    assert at(gap, nonexistent="shift_forward") == dt.datetime(2024, 3, 10, 7) and at(gap, nonexistent="shift_backward") == dt.datetime(2024, 3, 10, 6, 59, 59, 999999)
    assert at(day((7, 1), 12, 0)) == dt.datetime(2024, 7, 1, 16) and at(day((1, 1), 12, 0)) == dt.datetime(2024, 1, 1, 17)
    for df, word in ((overlap, "ambiguous"), (gap, "nonexistent")):
        with pytest.raises(Exception, match=word):
            at(df)
    got = day((7, 1), 12).select(T.is_dst(F.col("t"), "America/New_York"), T.is_dst(F.col("t"), "Asia/Tokyo"), T.is_dst(F.col("t"), "Australia/Sydney")).first()
    assert tuple(got) == (True, False, False)


def test_boundary_counts(spark):
    a, b = dt.datetime(2023, 12, 31, 23), dt.datetime(2024, 1, 1, 1)
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(*[T.between(F.col("a"), F.col("b"), u) for u in ("year", "quarter", "month", "week", "day", "hour")]).first()
    assert tuple(got) == (1, 1, 1, 1, 1, 2)


def test_weeks(times):
    series, df = times
    got = df.select(T.iso_week(F.col("ts")), T.iso_year(F.col("ts")), T.us_week(F.col("ts")), T.day_of_week(F.col("ts"), week_start=7)).collect()
    iso = series.index.isocalendar()
    assert [(r[0], r[1]) for r in got] == list(zip(iso.week, iso.year, strict=True)) and all(r[3] == (t.weekday() + 1) % 7 for r, t in zip(got, series.index, strict=True))


@pytest.mark.parametrize("mask", ["1111100", "1110011", "1000000"])
def test_business_days_as_numpy(mask):
    rng = np.random.default_rng(2)
    off = [D(2024, 1, 1) + dt.timedelta(int(k)) for k in rng.integers(0, 400, 25)]
    cal, np_cal = BusinessDays(mask, tuple(off)), np.busdaycalendar(mask, [str(h) for h in off])
    for _ in range(200):
        d, n = D(2024, 1, 1) + dt.timedelta(int(rng.integers(0, 400))), int(rng.integers(-60, 60))
        for roll in ("following", "preceding", "modifiedfollowing", "modifiedpreceding"):
            assert cal.offset(d, n, roll) == np.busday_offset(str(d), n, roll, busdaycal=np_cal).astype(object)
        e = d + dt.timedelta(n)
        assert cal.count(d, e) == np.busday_count(str(d), str(e), busdaycal=np_cal) and cal.is_busday(d) == np.is_busday(str(d), busdaycal=np_cal)
    with pytest.raises(ValueError, match="no business day"):
        cal.roll(next(h for h in off if not cal.is_busday(h)))


def test_custom_business_day_offset():
    off = (D(2024, 7, 4), D(2024, 7, 5))
    them = pd.offsets.CustomBusinessDay(1, holidays=[str(h) for h in off])
    for k in range(1, 12):
        t = dt.datetime(2024, 7, k, 9, 30)
        for n in (1, 3, -1, -4):
            assert pd.Timestamp(cbday(n, holidays=off).add(t)) == pd.Timestamp(t) + them * n
    assert not cbday(holidays=off).on_offset(dt.datetime(2024, 7, 4))


def test_business_day_columns(spark):
    cal = BusinessDays(holidays=(D(2024, 7, 4),))
    df = spark.createDataFrame([(D(2024, 7, k),) for k in range(1, 15)], "d date")
    for n in (1, 3, -2):
        roll = "following" if n > 0 else "preceding"
        got = cal.add_days(df, "d", n, D(2024, 6, 1), D(2024, 8, 31)).collect()
        assert all(r["moved"] == cal.offset(r["d"], n, roll) for r in got)


def test_holidays():
    got = dict(H.US_FEDERAL.named(D(2021, 1, 1), D(2021, 12, 31)))
    assert got[D(2021, 7, 5)] == "Independence Day" and D(2021, 12, 24) in got and D(2021, 6, 18) in got
    nyse = H.NYSE.holidays(D(2024, 1, 1), D(2024, 12, 31))
    assert nyse == [D(2024, 1, 1), D(2024, 1, 15), D(2024, 2, 19), D(2024, 3, 29), D(2024, 5, 27), D(2024, 6, 19), D(2024, 7, 4), D(2024, 9, 2), D(2024, 11, 28), D(2024, 12, 25)]
    uk = H.UK.holidays(D(2021, 12, 1), D(2021, 12, 31))
    assert uk == [D(2021, 12, 27), D(2021, 12, 28)]
    assert H.NYSE.merged(H.UK).rule("Boxing Day") and H.before_nearest_workday(D(2024, 7, 6)) == D(2024, 7, 4)


def test_schedule(spark):
    nyse = get_calendar("NASDAQ")
    rows = {r["date"]: r for r in nyse.schedule(spark, D(2024, 11, 25), D(2024, 12, 2), ("open", "close")).collect()}
    assert sorted(rows) == [D(2024, 11, k) for k in (25, 26, 27, 29)] + [D(2024, 12, 2)]
    utc = lambda r, k: r[k].astimezone(dt.UTC).replace(tzinfo=None)
    assert utc(rows[D(2024, 11, 25)], "open") == dt.datetime(2024, 11, 25, 14, 30) and utc(rows[D(2024, 11, 29)], "close") == dt.datetime(2024, 11, 29, 18)
    assert nyse.get_time("close", D(1960, 1, 4)).time == dt.time(15, 30)
    assert nyse.schedule(spark, D(1984, 12, 31), D(1985, 1, 2), ("open",)).count() == 2
    assert len(CALENDARS) == 17 and get_calendar("BTC").valid_days(spark, D(2024, 1, 6), D(2024, 1, 7)).count() == 2
    assert get_calendar("FX").date_range_htf(spark, D(2024, 1, 1), 3).count() == 3
    assert "break_start" in get_calendar("CME_Equity").schedule(spark, D(2024, 1, 2), D(2024, 1, 3)).columns


def test_merged_schedules_and_open(spark):
    a, b = (get_calendar(n).schedule(spark, D(2023, 7, 3), D(2023, 7, 7), ("open", "close")) for n in ("NYSE", "FX"))
    outer, inner = ([r["date"] for r in merge_schedules([a, b], o).collect()] for o in (True, False))
    assert D(2023, 7, 4) in outer and D(2023, 7, 4) not in inner
    asked = spark.createDataFrame([(1, dt.datetime(2023, 7, 3, 14)), (2, dt.datetime(2023, 7, 3, 18)), (3, dt.datetime(2023, 7, 4, 15)), (4, dt.datetime(2023, 7, 5, 13, 30))], "k long, t timestamp_ntz")
    got = {r["k"]: r["is_open"] for r in open_at_time(asked, "t", a).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
