"""Date offsets: rules that move a time to the n-th next or previous anchor, as values and as Column expressions.

An anchored offset first rolls onto its anchors: from a date between two, n > 0 counts the next anchor as the first.
Times of day are kept by fixed spans and business days and dropped by calendar anchors.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import from_micros, micros

DAY = dt.timedelta(days=1)


@dataclass(frozen=True)
class Offset:
    """n anchors. Subclasses say where anchors are, by the number of their period."""

    n: int = 1

    def __mul__(self, k: int) -> Offset:
        return replace(self, n=self.n * k)

    def __neg__(self) -> Offset:
        return self * -1

    @property
    def base(self) -> Offset:
        return replace(self, n=1)

    def on_offset(self, t: dt.datetime) -> bool:
        raise NotImplementedError

    def add(self, t: dt.datetime) -> dt.datetime:
        raise NotImplementedError

    def subtract(self, t: dt.datetime) -> dt.datetime:
        return (-self).add(t)

    def rollforward(self, t: dt.datetime) -> dt.datetime:
        return t if self.on_offset(t) else self.base.add(t)

    def rollback(self, t: dt.datetime) -> dt.datetime:
        return t if self.on_offset(t) else (-self.base).add(t)

    def column(self, c: Column) -> Column:
        """c moved by this offset."""
        raise NotImplementedError

    def range(self, start: dt.datetime, end: dt.datetime | None = None, periods: int | None = None) -> list[dt.datetime]:
        """Anchors from start on: up to end, or so many."""
        out, t = [], self.rollforward(start) if self.n > 0 else self.rollback(start)
        while (periods is None or len(out) < periods) and (end is None or (t <= end if self.n > 0 else t >= end)):
            out.append(t)
            t = self.add(t)
        return out


@dataclass(frozen=True)
class Tick(Offset):
    """A fixed span of microseconds; every time is on it."""

    span: int = 1

    def on_offset(self, t: dt.datetime) -> bool:
        return True

    def add(self, t: dt.datetime) -> dt.datetime:
        return t + dt.timedelta(microseconds=self.n * self.span)

    def column(self, c: Column) -> Column:
        return from_micros(micros(c) + F.lit(self.n * self.span))


def micro(n: int = 1) -> Tick:
    return Tick(n, 1)


def millis(n: int = 1) -> Tick:
    return Tick(n, 1_000)


def seconds(n: int = 1) -> Tick:
    return Tick(n, 1_000_000)


def minutes(n: int = 1) -> Tick:
    return Tick(n, 60_000_000)


def hours(n: int = 1) -> Tick:
    return Tick(n, 3_600_000_000)


def days(n: int = 1) -> Tick:
    return Tick(n, 86_400_000_000)


@dataclass(frozen=True)
class Week(Offset):
    """Weeks; with a weekday (0 Monday) anchored to it. The time of day is kept."""

    weekday: int | None = None

    def on_offset(self, t: dt.datetime) -> bool:
        return self.weekday is None or t.weekday() == self.weekday

    def add(self, t: dt.datetime) -> dt.datetime:
        if self.on_offset(t):
            return t + self.n * 7 * DAY
        ahead = (self.weekday - t.weekday()) % 7
        return t + (ahead + 7 * (self.n - 1 if self.n > 0 else self.n)) * DAY

    def column(self, c: Column) -> Column:
        if self.weekday is None:
            return from_micros(micros(c) + F.lit(self.n * 7 * 86_400_000_000))
        ahead = F.pmod(F.lit(self.weekday) - F.weekday(c), F.lit(7))
        weeks = F.when(ahead == 0, F.lit(self.n)).otherwise(F.lit(self.n - 1 if self.n > 0 else self.n))
        return from_micros(micros(c) + (ahead + 7 * weeks).cast("long") * F.lit(86_400_000_000))


def _days_in(year: int, month: int) -> int:
    return calendar.monthrange(year, month)[1]


@dataclass(frozen=True)
class MonthAnchor(Offset):
    """First or last day of every `every`-th month, counted so that `month` is one of them; at midnight.

    business: the first or last weekday (Monday to Friday) of the month instead.
    """

    every: int = 1
    month: int = 1
    end: bool = False
    business: bool = False

    def _anchor(self, index: int) -> dt.datetime:
        """Anchor of the period with this number."""
        months = index * self.every + self.month - 1
        y, m = divmod(months, 12)
        d = _days_in(y, m + 1) if self.end else 1
        t = dt.datetime(y, m + 1, d)
        if self.business:
            w = t.weekday()
            t += DAY * ((-(w - 4) if w > 4 else 0) if self.end else (7 - w if w > 4 else 0))
        return t

    def on_offset(self, t: dt.datetime) -> bool:
        months = t.year * 12 + t.month - self.month
        return months % self.every == 0 and self._anchor(months // self.every).date() == t.date()

    def add(self, t: dt.datetime) -> dt.datetime:
        k = (t.year * 12 + t.month - self.month) // self.every
        day = dt.datetime(t.year, t.month, t.day)
        a = self._anchor(k)
        if self.n > 0:
            k += self.n if a <= day else self.n - 1
        elif self.n < 0:
            k += self.n if a >= day else self.n + 1
        elif a < day:
            k += 1
        return self._anchor(k)

    def _anchor_column(self, index: Column) -> Column:
        first = F.make_date((F.floor((index * self.every + self.month - 1) / 12)).cast("int"), (F.pmod(index * self.every + F.lit(self.month - 1), F.lit(12)) + 1).cast("int"), F.lit(1))
        d = F.last_day(first) if self.end else first
        if self.business:
            w = F.weekday(d)
            d = F.date_sub(d, F.greatest(w - 4, F.lit(0))) if self.end else F.date_add(d, F.when(w > 4, 7 - w).otherwise(0))
        return d

    def column(self, c: Column) -> Column:
        day = F.to_date(c)
        k = F.floor((F.year(c) * 12 + F.month(c) - self.month) / self.every).cast("int")
        a = self._anchor_column(k)
        if self.n > 0:
            k = k + F.when(a <= day, self.n).otherwise(self.n - 1)
        elif self.n < 0:
            k = k + F.when(a >= day, self.n).otherwise(self.n + 1)
        else:
            k = k + F.when(a < day, 1).otherwise(0)
        return self._anchor_column(k).cast("timestamp_ntz")


def month_start(n: int = 1) -> MonthAnchor:
    return MonthAnchor(n)


def month_end(n: int = 1) -> MonthAnchor:
    return MonthAnchor(n, end=True)


def quarter_start(n: int = 1, starting_month: int = 1) -> MonthAnchor:
    return MonthAnchor(n, 3, (starting_month - 1) % 3 + 1)


def quarter_end(n: int = 1, starting_month: int = 12) -> MonthAnchor:
    return MonthAnchor(n, 3, (starting_month - 1) % 3 + 1, end=True)


def year_start(n: int = 1, month: int = 1) -> MonthAnchor:
    return MonthAnchor(n, 12, month)


def year_end(n: int = 1, month: int = 12) -> MonthAnchor:
    return MonthAnchor(n, 12, month, end=True)


def bmonth_begin(n: int = 1) -> MonthAnchor:
    return MonthAnchor(n, business=True)


def bmonth_end(n: int = 1) -> MonthAnchor:
    return MonthAnchor(n, end=True, business=True)


@dataclass(frozen=True)
class WeekOfMonth(Offset):
    """The week-th (from 0; -1 for the last) given weekday of each month; the time of day is kept."""

    week: int = 0
    weekday: int = 0

    def _anchor(self, months: int) -> dt.date:
        y, m = divmod(months, 12)
        if self.week < 0:
            last = dt.date(y, m + 1, _days_in(y, m + 1))
            return last - DAY * ((last.weekday() - self.weekday) % 7)
        first = dt.date(y, m + 1, 1)
        return first + DAY * ((self.weekday - first.weekday()) % 7 + 7 * self.week)

    def _anchor_column(self, k: Column) -> Column:
        first = F.make_date(F.floor(k / 12).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int"), F.lit(1))
        if self.week < 0:
            last = F.last_day(first)
            return F.date_sub(last, F.pmod(F.weekday(last) - self.weekday, F.lit(7)))
        return F.date_add(first, F.pmod(F.lit(self.weekday) - F.weekday(first), F.lit(7)) + 7 * self.week)

    def on_offset(self, t: dt.datetime) -> bool:
        return self._anchor(t.year * 12 + t.month - 1) == t.date()

    def add(self, t: dt.datetime) -> dt.datetime:
        k = t.year * 12 + t.month - 1
        a = self._anchor(k)
        if self.n > 0:
            k += self.n if a <= t.date() else self.n - 1
        else:
            k += self.n if a >= t.date() else self.n + 1
        return dt.datetime.combine(self._anchor(k), t.time())

    def column(self, c: Column) -> Column:
        anchor = self._anchor_column
        day, k = F.to_date(c), (F.year(c) * 12 + F.month(c) - 1).cast("int")
        step = F.when(anchor(k) <= day, self.n).otherwise(self.n - 1) if self.n > 0 else F.when(anchor(k) >= day, self.n).otherwise(self.n + 1)
        moved = F.datediff(anchor(k + step), day)
        return from_micros(micros(c) + moved.cast("long") * F.lit(86_400_000_000))


def week_of_month(n: int = 1, week: int = 0, weekday: int = 0) -> WeekOfMonth:
    return WeekOfMonth(n, week, weekday)


def last_week_of_month(n: int = 1, weekday: int = 0) -> WeekOfMonth:
    return WeekOfMonth(n, -1, weekday)


def easter(year: int) -> dt.date:
    """Western Easter Sunday, by the anonymous Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


@dataclass(frozen=True)
class Easter(Offset):
    """Easter Sundays, at midnight."""

    def on_offset(self, t: dt.datetime) -> bool:
        return easter(t.year) == t.date()

    def add(self, t: dt.datetime) -> dt.datetime:
        a = easter(t.year)
        y = t.year + ((self.n if a <= t.date() else self.n - 1) if self.n > 0 else (self.n if a >= t.date() else self.n + 1))
        return dt.datetime.combine(easter(y), dt.time())

    def column(self, c: Column) -> Column:
        def sunday(y: Column) -> Column:
            div = lambda x, n: F.floor(x / n).cast("int")
            a, b, r = y % 19, div(y, 100), y % 100
            h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
            k = (32 + 2 * (b % 4) + 2 * div(r, 4) - h - r % 4) % 7
            m = div(a + 11 * h + 22 * k, 451)
            s = h + k - 7 * m + 114
            return F.make_date(y, div(s, 31), s % 31 + 1)

        y, day = F.year(c), F.to_date(c)
        step = F.when(sunday(y) <= day, self.n).otherwise(self.n - 1) if self.n > 0 else F.when(sunday(y) >= day, self.n).otherwise(self.n + 1)
        return sunday(y + step).cast("timestamp_ntz")


@dataclass(frozen=True)
class BDay(Offset):
    """Monday to Friday; the time of day is kept, and `delta` added."""

    delta: dt.timedelta = field(default_factory=dt.timedelta)

    def on_offset(self, t: dt.datetime) -> bool:
        return t.weekday() < 5

    def add(self, t: dt.datetime) -> dt.datetime:
        w, n = t.weekday(), self.n
        if w > 4:
            t, n, w = (t - DAY * (w - 4), n, 4) if n > 0 else (t + DAY * (7 - w), n, 0)
        weeks, rest = divmod(w + n, 5)
        return t + DAY * (7 * weeks + rest - w) + self.delta

    def column(self, c: Column) -> Column:
        w = F.weekday(c)
        onto = F.when(w > 4, 4 - w if self.n > 0 else 7 - w).otherwise(0)
        w = F.when(w > 4, 4 if self.n > 0 else 0).otherwise(w)
        total = w + self.n
        moved = onto + 7 * F.floor(total / 5) + F.pmod(total, F.lit(5)) - w
        extra = self.delta // dt.timedelta(microseconds=1)
        return from_micros(micros(c) + moved.cast("long") * F.lit(86_400_000_000) + F.lit(extra))


def bday(n: int = 1, delta: dt.timedelta = dt.timedelta()) -> BDay:
    return BDay(n, delta)


@dataclass(frozen=True)
class RelativeDelta(Offset):
    """Years, months (clipped to the month's length), then weeks, days and times; absolute fields are set first.

    weekday = (day, k): on to the k-th such weekday from there, counting the day itself (backwards for k < 0).
    """

    years: int = 0
    months: int = 0
    weeks: int = 0
    days: int = 0
    hours: int = 0
    minutes: int = 0
    seconds: int = 0
    microseconds: int = 0
    year: int | None = None
    month: int | None = None
    day: int | None = None
    hour: int | None = None
    minute: int | None = None
    second: int | None = None
    microsecond: int | None = None
    weekday: tuple[int, int] | None = None

    def on_offset(self, t: dt.datetime) -> bool:
        return True

    def add(self, t: dt.datetime) -> dt.datetime:
        for _ in range(abs(self.n)):
            s = 1 if self.n > 0 else -1
            y, m = self.year or t.year, self.month or t.month
            total = y * 12 + m - 1 + s * (self.years * 12 + self.months)
            y, m = divmod(total, 12)
            d = min(self.day or t.day, _days_in(y, m + 1))
            pick = lambda own, had: had if own is None else own
            t = t.replace(y, m + 1, d, pick(self.hour, t.hour), pick(self.minute, t.minute), pick(self.second, t.second), pick(self.microsecond, t.microsecond))
            t += s * dt.timedelta(days=self.days + 7 * self.weeks, hours=self.hours, minutes=self.minutes, seconds=self.seconds, microseconds=self.microseconds)
            if self.weekday:
                w, k = self.weekday
                ahead = (w - t.weekday()) % 7 if k > 0 else -((t.weekday() - w) % 7)
                t += DAY * (ahead + 7 * (abs(k) - 1) * (1 if k > 0 else -1))
        return t

    def column(self, c: Column) -> Column:
        if self.n not in (1, -1) or any(x is not None for x in (self.year, self.month, self.day, self.hour, self.minute, self.second, self.microsecond, self.weekday)):
            raise ValueError("absolute fields, weekdays and repeats have no column form")
        s = self.n
        day = F.add_months(F.to_date(c), s * (12 * self.years + self.months))
        clipped = F.least(F.dayofmonth(c), F.dayofmonth(F.last_day(day)))
        day = F.date_add(F.trunc(day, "month"), clipped - 1)
        time = F.pmod(micros(c), F.lit(86_400_000_000))
        span = dt.timedelta(days=self.days + 7 * self.weeks, hours=self.hours, minutes=self.minutes, seconds=self.seconds, microseconds=self.microseconds)
        return from_micros(micros(day) + time + F.lit(s * (span // dt.timedelta(microseconds=1))))


def date_offset(n: int = 1, **fields) -> RelativeDelta:
    return RelativeDelta(n, **fields)


@dataclass(frozen=True)
class SessionAnchor(Offset):
    """On offset at `delta` after the open, or before the close, of a session given in local times of day."""

    open: dt.time = dt.time(9, 30)
    close: dt.time = dt.time(16, 0)
    before_close: bool = False
    delta: dt.timedelta = field(default_factory=dt.timedelta)

    def _at(self) -> int:
        t = self.close if self.before_close else self.open
        day = dt.timedelta(hours=t.hour, minutes=t.minute, seconds=t.second, microseconds=t.microsecond)
        return ((day - self.delta if self.before_close else day + self.delta) // dt.timedelta(microseconds=1)) % 86_400_000_000

    def on_offset(self, t: dt.datetime) -> bool:
        return (t - dt.datetime.combine(t.date(), dt.time())) // dt.timedelta(microseconds=1) == self._at()

    def is_on_column(self, c: Column) -> Column:
        return F.pmod(micros(c), F.lit(86_400_000_000)) == self._at()


# The short codes of frequencies.
CODES = {"us": micro, "ms": millis, "s": seconds, "min": minutes, "h": hours, "D": days, "W": lambda n=1: Week(n, 6), "MS": month_start, "ME": month_end, "QS": quarter_start, "QE": quarter_end, "YS": year_start, "YE": year_end, "B": bday, "BMS": bmonth_begin, "BME": bmonth_end}


def parse(freq: str | Offset) -> Offset:
    """An offset from a code such as 5min, 1h, D, W, ME."""
    if isinstance(freq, Offset):
        return freq
    number = "".join(ch for ch in freq if ch.isdigit())
    code = freq[len(number) :]
    if code not in CODES:
        raise ValueError(f"unknown frequency {freq!r}")
    return CODES[code](int(number or 1))
