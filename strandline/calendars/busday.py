"""Business days of a week mask without holidays: on the driver by date, on tables by an ordinal."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.offsets import Offset

DAY = dt.timedelta(days=1)
ROLLS = ("following", "preceding", "modifiedfollowing", "modifiedpreceding", "nat", "raise")


@dataclass(frozen=True)
class BusinessDays:
    """weekmask: Monday to Sunday. Holidays are dates that don't count."""

    weekmask: str = "1111100"
    holidays: tuple[dt.date, ...] = ()
    _off: tuple[dt.date, ...] = field(init=False, repr=False, compare=False, default=())

    def __post_init__(self) -> None:
        if len(self.weekmask) != 7 or "1" not in self.weekmask:
            raise ValueError("a week mask has seven digits, one of them 1")
        object.__setattr__(self, "_off", tuple(sorted({h for h in self.holidays if self.weekmask[h.weekday()] == "1"})))

    def is_busday(self, d: dt.date) -> bool:
        k = bisect_left(self._off, d)
        return self.weekmask[d.weekday()] == "1" and not (k < len(self._off) and self._off[k] == d)

    def roll(self, d: dt.date, how: str = "raise") -> dt.date | None:
        """The business day that a date counts as; modified rolls turn back at the end of a month."""
        if how not in ROLLS:
            raise ValueError(f"unknown roll {how!r}")
        if self.is_busday(d):
            return d
        if how == "raise":
            raise ValueError(f"{d} is no business day")
        if how == "nat":
            return None
        ahead = how.endswith("following")
        out = self._next(d, 1 if ahead else -1)
        return self._next(d, -1 if ahead else 1) if how.startswith("modified") and out.month != d.month else out

    def _next(self, d: dt.date, step: int) -> dt.date:
        while True:
            d += step * DAY
            if self.is_busday(d):
                return d

    def offset(self, d: dt.date, n: int, roll: str = "raise") -> dt.date | None:
        """n business days on from d's roll."""
        at = self.roll(d, roll)
        if at is None or n == 0:
            return at
        week = self.weekmask.count("1")
        step = 1 if n > 0 else -1
        far = at + step * (7 * (abs(n) // week + 2) + len(self._off) // max(1, week) * 7 + 14) * DAY
        low, high = 0, abs((far - at).days)  # the least distance that passes n business days
        while low < high:
            mid = (low + high) // 2
            passed = self.count(at + DAY, at + (mid + 1) * DAY) if step > 0 else self.count(at - mid * DAY, at)
            low, high = (low, mid) if passed >= abs(n) else (mid + 1, high)
        return at + step * low * DAY

    def count(self, start: dt.date, end: dt.date) -> int:
        """Business days in [start, end); negative, over (end, start], when end is before start."""
        if end < start:
            return -self.count(end + DAY, start + DAY)
        weeks, rest = divmod((end - start).days, 7)
        n = weeks * self.weekmask.count("1") + sum(self.weekmask[(start + k * DAY).weekday()] == "1" for k in range(rest))
        return n - (bisect_left(self._off, end) - bisect_left(self._off, start))

    def table(self, spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
        """(date, is_busday, ordinal) of each day: ordinal counts business days up to it, so differences count days between."""
        days = spark.range((end - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
        open_ = F.element_at(F.split(F.lit(",".join(self.weekmask)), ","), F.weekday("date") + 1) == "1"
        off = [h for h in self._off if start <= h <= end]
        is_open = open_ & ~F.col("date").isin(off) if off else open_
        rows = days.withColumn("is_busday", is_open)
        return rows.withColumn("ordinal", F.count_if("is_busday").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))

    def add_days(self, df: DataFrame, column: str, n: int, start: dt.date, end: dt.date, name: str = "moved") -> DataFrame:
        """df with a date column moved by n business days (from the next one where it is none, for n > 0; the previous for n < 0).

        Dates must lie in [start, end], as far apart as a calendar table for a broadcast join.
        """
        cal = self.table(df.sparkSession, start, end)
        here = cal.select(F.col("date").alias("__d"), F.when(F.col("is_busday"), F.col("ordinal")).otherwise(F.col("ordinal") + (1 if n > 0 else 0)).alias("__o"))
        there = cal.where("is_busday").select(F.col("ordinal").alias("__t"), F.col("date").alias(name))
        step = F.col("__o") + n
        out = df.join(F.broadcast(here), F.to_date(column) == F.col("__d"), "left").join(F.broadcast(there), step == F.col("__t"), "left")
        return out.drop("__d", "__o", "__t")


@dataclass(frozen=True)
class CBDay(Offset):
    """n business days of a calendar on; from a day off, the next (n > 0) or previous one counts as the first. Times of day are kept."""

    calendar: BusinessDays = field(default_factory=BusinessDays)
    delta: dt.timedelta = field(default_factory=dt.timedelta)

    def on_offset(self, t: dt.datetime) -> bool:
        return self.calendar.is_busday(t.date())

    def add(self, t: dt.datetime) -> dt.datetime:
        roll = "preceding" if self.n > 0 else "following"
        return dt.datetime.combine(self.calendar.offset(t.date(), self.n, roll), t.time()) + self.delta


def cbday(n: int = 1, weekmask: str = "1111100", holidays: tuple[dt.date, ...] = (), delta: dt.timedelta = dt.timedelta()) -> CBDay:
    return CBDay(n, BusinessDays(weekmask, tuple(holidays)), delta)
