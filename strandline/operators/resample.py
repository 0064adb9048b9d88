"""Time buckets with the rules of pandas' resample: closed, label, origin, offset; fixed spans and calendar anchors.

A bucket is a closed-form expression of the row's time, so nothing is sorted or range-joined. Origins that depend on
the data (start, start_day, end, end_day) need one scalar aggregate. Empty buckets don't appear unless `fill_gaps`
asks for them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..calendars.busday import CBDay
from ..functions.offsets import BDay, MonthAnchor, Offset, Tick, Week, WeekOfMonth, parse
from ..functions.temporal import from_wall_micros, wall_micros
from .aggregate import order_key

DAY = 86_400_000_000
EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Resample:
    """freq: a code such as 15min, D, W, ME, or an Offset. origin: epoch, start, start_day, end, end_day or a naive time."""

    freq: str | Offset
    closed: str | None = None
    label: str | None = None
    origin: str | dt.datetime = "start_day"
    offset: dt.timedelta = dt.timedelta()
    tz: str | None = None

    @property
    def rule(self) -> Offset:
        return parse(self.freq)

    def sides(self) -> tuple[str, str]:
        """closed and label; right where the frequency ends its periods or the origin is an end, else left."""
        r = self.rule
        ends = (isinstance(r, MonthAnchor) and r.end) or isinstance(r, Week) or self.origin in ("end", "end_day")
        side = "right" if ends else "left"
        return self.closed or side, self.label or side


def _origin(df: DataFrame, time: Column, o: Resample, closed: str) -> int:
    """Microseconds of the grid's origin."""
    extra = o.offset // dt.timedelta(microseconds=1)
    if o.origin == "epoch":
        return extra
    if isinstance(o.origin, dt.datetime):
        return (o.origin - EPOCH) // dt.timedelta(microseconds=1) + extra
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        return extra
    span = o.rule.n * o.rule.span
    if o.origin == "start":
        return low + extra
    if o.origin == "start_day":
        return low - low % DAY + extra
    if o.origin in ("end", "end_day"):
        last = high if o.origin == "end" else -(-high // DAY) * DAY
        k = (last - low) // span + (1 if closed == "left" else 0)
        return last - k * span + extra
    raise ValueError(f"unknown origin {o.origin!r}")


def bucket(df: DataFrame, time: str, o: Resample) -> Column:
    """The label of each row's bucket, as timestamp_ntz (an instant in UTC where o.tz says that time is one)."""
    closed, label = o.sides()
    wall = F.col(time).cast("timestamp_ntz")
    if o.tz:
        utc = wall if df.schema[time].dataType.typeName() == "timestamp_ntz" else F.convert_timezone(None, F.lit("UTC"), wall)
        wall = F.convert_timezone(F.lit("UTC"), F.lit(o.tz), utc)
    t, rule = wall_micros(wall), o.rule
    if isinstance(rule, Tick):
        span = rule.n * rule.span
        at = F.lit(_origin(df, t, o, closed))
        start = t - F.pmod(t - at, F.lit(span)) if closed == "left" else t + F.pmod(at - t, F.lit(span)) - F.lit(span)
        out = from_wall_micros(start + (F.lit(span) if label == "right" else F.lit(0)))
    elif isinstance(rule, Week):
        out = _week(wall, rule, closed, label)
    elif isinstance(rule, MonthAnchor):
        out = _month(wall, rule, closed, label)
    elif isinstance(rule, BDay):
        out = _business(df, wall, rule, closed, label)
    elif isinstance(rule, WeekOfMonth):
        out = _week_of_month(df, wall, rule, closed, label)
    elif isinstance(rule, CBDay):
        out = _open_days(wall, rule, closed, label)
    else:
        raise ValueError(f"no buckets for {rule!r}")
    return F.convert_timezone(F.lit(o.tz), F.lit("UTC"), out) if o.tz else out


def _last_moment(wall: Column, closed: str) -> Column:
    """The time that says which bucket a row is in, if buckets hold their first moment: one microsecond before where they hold their last."""
    return wall if closed == "left" else from_wall_micros(wall_micros(wall) - 1)


def _business(df: DataFrame, wall: Column, rule: BDay, closed: str, label: str) -> Column:
    """Buckets of n weekdays from the first row's day (or, closed right, n weekdays before it); a weekend is part of its Friday."""

    def ordinal(d: Column) -> Column:
        days = F.datediff(d, F.lit("1969-12-29"))  # a Monday
        return 5 * F.floor(days / 7) + F.least(F.pmod(days, F.lit(7)), F.lit(4))

    k = ordinal(F.to_date(_last_moment(wall, closed)))
    if rule.n > 1:
        low = df.agg(F.min(F.to_date(wall))).first()[0]
        start = BDay(1).rollback(dt.datetime.combine(low, dt.time())) if low and closed == "left" else BDay(-rule.n).add(dt.datetime.combine(low, dt.time())) if low else EPOCH
        origin = ordinal(F.lit(start.date()))
        k = origin + rule.n * F.floor((k - origin) / rule.n)
    k = k + (rule.n if label == "right" else 0)
    return F.date_add(F.lit("1969-12-29").cast("date"), (7 * F.floor(k / 5) + F.pmod(k, F.lit(5))).cast("int")).cast("timestamp_ntz")


def _week_of_month(df: DataFrame, wall: Column, rule: WeekOfMonth, closed: str, label: str) -> Column:
    """Buckets between the given weekday of one month and that of the n-th after; n > 1 counts from the first row's."""
    t = _last_moment(wall, closed)

    def start_of(c: Column) -> Column:
        k = (F.year(c) * 12 + F.month(c) - 1).cast("int")
        return k - F.when(rule._anchor_column(k) > F.to_date(c), 1).otherwise(0)

    k = start_of(t)
    if rule.n > 1:
        low = df.agg(F.min(F.to_date(wall))).first()[0] or EPOCH.date()
        one, back = WeekOfMonth(1, rule.week, rule.weekday), WeekOfMonth(-rule.n, rule.week, rule.weekday)
        low = (one.rollback if closed == "left" else back.add)(dt.datetime.combine(low, dt.time()))
        first = low.year * 12 + low.month - 1
        k = first + rule.n * F.floor((k - first) / rule.n).cast("int")
    return rule._anchor_column(k + (rule.n if label == "right" else 0)).cast("timestamp_ntz")


def _open_days(wall: Column, rule: CBDay, closed: str, label: str) -> Column:
    """Buckets of one business day of a calendar; days off are part of the open day before."""
    if rule.n != 1:
        raise ValueError("custom business days have buckets of one day")
    off = rule.calendar.holidays
    run, longest = 0, 0  # the longest run of days off about the calendar's holidays
    for h in sorted(off):
        day, run = h, 0
        while not rule.calendar.is_busday(day):
            day, run = day - dt.timedelta(days=1), run + 1
        longest = max(longest, run)
    reach = max(longest, 7) + 7
    mask = F.array(*[F.lit(x == "1") for x in rule.calendar.weekmask])
    closed_days = F.array(*[F.lit(h) for h in off]) if off else F.array().cast("array<date>")
    is_open = lambda d: F.element_at(mask, F.weekday(d) + 1) & ~F.array_contains(closed_days, d)
    d = F.to_date(_last_moment(wall, closed))
    if label == "left":
        return F.element_at(F.filter(F.sequence(F.date_sub(d, reach), d), is_open), -1).cast("timestamp_ntz")
    return F.element_at(F.filter(F.sequence(F.date_add(d, 1), F.date_add(d, reach)), is_open), 1).cast("timestamp_ntz")


def _week(wall: Column, rule: Week, closed: str, label: str) -> Column:
    """Periods of n weeks that end with the anchor weekday; n > 1 counts from 1970."""
    anchor = 6 if rule.weekday is None else rule.weekday
    d = F.to_date(wall)
    end = F.date_add(d, F.pmod(F.lit(anchor) - F.weekday(d), F.lit(7)))
    if closed == "left":
        end = F.when(end == d, F.date_add(end, 7)).otherwise(end)
    if rule.n > 1:
        k = F.floor((F.datediff(end, F.lit(EPOCH.date())) - (anchor - 3)) / 7)
        end = F.date_add(end, (7 * F.pmod(-k, F.lit(rule.n))).cast("int"))
    return (end if label == "right" else F.date_sub(end, 7 * rule.n)).cast("timestamp_ntz")


def _month(wall: Column, rule: MonthAnchor, closed: str, label: str) -> Column:
    """Periods between anchors; an end anchor closes on its whole day, a start anchor on its midnight."""
    d = F.to_date(wall)
    k = F.floor((F.year(d) * 12 + F.month(d) - rule.month) / rule.every).cast("int")
    if rule.every > 1 and rule.end:
        k = F.ceil((F.year(d) * 12 + F.month(d) - rule.month) / rule.every).cast("int")
    anchor = rule._anchor_column(k)
    if rule.end:
        beyond = (d >= anchor) if closed == "left" else (d > anchor)
        end = k + F.when(beyond, 1).otherwise(0)
        return rule._anchor_column(end if label == "right" else end - 1).cast("timestamp_ntz")
    at = anchor.cast("timestamp_ntz")
    before = (wall < at) if closed == "left" else (wall <= at)
    start = k - F.when(before, 1).otherwise(0)
    return rule._anchor_column(start + 1 if label == "right" else start).cast("timestamp_ntz")


def resample(df: DataFrame, time: str, o: Resample, keys: list[str] | None = None, name: str | None = None):
    """Grouped by keys and bucket, ready for agg()."""
    return df.groupBy(*(keys or []), bucket(df, time, o).alias(name or time))


def ohlcv(df: DataFrame, time: str, o: Resample, keys: list[str] | None = None, order: list[str] | None = None, columns: dict[str, str] | None = None, name: str | None = None) -> DataFrame:
    """Open, high, low, close and volume bars (and the last contract, where columns names one), one partial aggregation.

    columns: from open, high, low, close, volume, contract to df's columns (o, h, l, c, v, s by default).
    """
    names = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"} | (columns or {})
    at = order_key(df, list(dict.fromkeys([time, *(order or [])])))
    cols = [
        F.min_by(names["open"], at).cast("double").alias("open"),
        F.max(names["high"]).cast("double").alias("high"),
        F.min(names["low"]).cast("double").alias("low"),
        F.max_by(names["close"], at).cast("double").alias("close"),
        F.sum(names["volume"]).cast("double").alias("volume"),
    ]
    if "contract" in names:
        cols.append(F.max_by(names["contract"], at).alias("contract"))
    return resample(df, time, o, keys, name).agg(*cols)


def fill_gaps(bars: DataFrame, time: str, o: Resample, keys: list[str] | None = None) -> DataFrame:
    """bars with a row of nulls for each empty bucket between a key's first and last, for fixed spans."""
    rule = o.rule
    if not isinstance(rule, Tick):
        raise ValueError("gaps are filled for fixed spans only")
    keys = keys or []
    step = F.expr(f"interval {rule.n * rule.span} microseconds")
    ends = bars.groupBy(*keys).agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    grid = ends.select(*keys, F.explode(F.sequence("__a", "__b", step)).alias(time))
    return grid.join(bars, [*keys, time], "left")
