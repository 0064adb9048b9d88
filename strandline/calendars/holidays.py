"""Holiday rules: a month and day, or a weekday's place in a month, or days from Easter, and how they are observed."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.offsets import easter

DAY = dt.timedelta(days=1)
Observance = Callable[[dt.date], dt.date]


def _moved(by: dict[int, int]) -> Observance:
    """Move by so many days on given weekdays (0 Monday)."""
    return lambda d: d + by.get(d.weekday(), 0) * DAY


next_monday = _moved({5: 2, 6: 1})
next_monday_or_tuesday = _moved({5: 2, 6: 2, 0: 1})
previous_friday = _moved({5: -1, 6: -2})
sunday_to_monday = _moved({6: 1})
weekend_to_monday = _moved({5: 2, 6: 1})
nearest_workday = _moved({5: -1, 6: 1})
next_workday = _moved({4: 3, 5: 2, 6: 1, 0: 1, 1: 1, 2: 1, 3: 1})
previous_workday = _moved({0: -3, 6: -2, 5: -1, 1: -1, 2: -1, 3: -1, 4: -1})


def before_nearest_workday(d: dt.date) -> dt.date:
    return previous_workday(nearest_workday(d))


def after_nearest_workday(d: dt.date) -> dt.date:
    return next_workday(nearest_workday(d))


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month, from 1, or from its end for n < 0."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + ((weekday - first.weekday()) % 7 + 7 * (n - 1)) * DAY
    last = dt.date(year, month, calendar.monthrange(year, month)[1])
    return last - ((last.weekday() - weekday) % 7 + 7 * (-n - 1)) * DAY


@dataclass(frozen=True)
class Holiday:
    """One of: month and day; month and nth=(weekday, n); easter=days after Easter Sunday. plus: days added to it.

    start and end bound the dates it applies to; days_of_week keeps only dates on those weekdays.
    """

    name: str
    month: int | None = None
    day: int | None = None
    nth: tuple[int, int] | None = None
    easter: int | None = None
    year: int | None = None
    plus: int = 0
    observance: Observance | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    days_of_week: tuple[int, ...] | None = None

    def date(self, year: int) -> dt.date:
        if self.easter is not None:
            d = easter(year) + self.easter * DAY
        elif self.nth is not None:
            d = nth_weekday(year, self.month, *self.nth)
        else:
            d = dt.date(year, self.month, self.day)
        d += self.plus * DAY
        return self.observance(d) if self.observance else d

    def dates(self, start: dt.date, end: dt.date) -> list[dt.date]:
        low, high = max(start, self.start or start), min(end, self.end or end)
        years = [self.year] if self.year else range(low.year - 1, high.year + 2)
        out = [d for y in years if 1 <= y < 9999 for d in [self.date(y)] if low <= d <= high]
        return [d for d in out if self.days_of_week is None or d.weekday() in self.days_of_week]


@dataclass(frozen=True)
class HolidayCalendar:
    name: str
    rules: tuple[Holiday, ...] = ()
    adhoc: tuple[dt.date, ...] = field(default=())

    def holidays(self, start: dt.date, end: dt.date) -> list[dt.date]:
        return sorted({d for d, _ in self.named(start, end)})

    def named(self, start: dt.date, end: dt.date) -> list[tuple[dt.date, str]]:
        out = {(d, r.name) for r in self.rules for d in r.dates(start, end)}
        return sorted(out | {(d, "ad hoc") for d in self.adhoc if start <= d <= end})

    def rule(self, name: str) -> Holiday | None:
        return next((r for r in self.rules if r.name == name), None)

    def merged(self, other: HolidayCalendar, name: str | None = None) -> HolidayCalendar:
        """Rules of both; this one's where names agree."""
        own = {r.name for r in self.rules}
        return HolidayCalendar(name or self.name, (*self.rules, *(r for r in other.rules if r.name not in own)), tuple(sorted({*self.adhoc, *other.adhoc})))

    def table(self, spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
        return spark.createDataFrame(self.named(start, end), "date date, name string")


MON, TUE, WED, THU, FRI = range(5)
D = dt.date

# Public holidays of the United States and their public rules.
NEW_YEAR = Holiday("New Year's Day", 1, 1, observance=nearest_workday)
NEW_YEAR_MONDAY = Holiday("New Year's Day", 1, 1, observance=sunday_to_monday, days_of_week=(0, 1, 2, 3, 4))
MLK = Holiday("Martin Luther King Jr. Day", 1, nth=(MON, 3), start=D(1986, 1, 1))
MLK_1998 = Holiday("Martin Luther King Jr. Day", 1, nth=(MON, 3), start=D(1998, 1, 1))
PRESIDENTS = Holiday("Washington's Birthday", 2, nth=(MON, 3), start=D(1971, 1, 1))
WASHINGTON_OLD = Holiday("Washington's Birthday before 1971", 2, 22, observance=nearest_workday, end=D(1970, 12, 31))
GOOD_FRIDAY = Holiday("Good Friday", easter=-2)
EASTER_MONDAY = Holiday("Easter Monday", easter=1)
MEMORIAL = Holiday("Memorial Day", 5, nth=(MON, -1), start=D(1971, 1, 1))
MEMORIAL_OLD = Holiday("Memorial Day before 1971", 5, 30, observance=nearest_workday, end=D(1970, 12, 31))
JUNETEENTH = Holiday("Juneteenth", 6, 19, observance=nearest_workday, start=D(2021, 6, 18))
JUNETEENTH_2022 = Holiday("Juneteenth", 6, 19, observance=nearest_workday, start=D(2022, 1, 1))
INDEPENDENCE = Holiday("Independence Day", 7, 4, observance=nearest_workday)
LABOR = Holiday("Labor Day", 9, nth=(MON, 1))
COLUMBUS = Holiday("Columbus Day", 10, nth=(MON, 2))
VETERANS = Holiday("Veterans Day", 11, 11, observance=nearest_workday)
THANKSGIVING = Holiday("Thanksgiving", 11, nth=(THU, 4), start=D(1942, 1, 1))
CHRISTMAS = Holiday("Christmas Day", 12, 25, observance=nearest_workday)

US_FEDERAL = HolidayCalendar("USFederalHolidayCalendar", (NEW_YEAR, MLK, PRESIDENTS, MEMORIAL, JUNETEENTH, INDEPENDENCE, LABOR, COLUMBUS, VETERANS, THANKSGIVING, CHRISTMAS))

# Days on which the New York Stock Exchange was closed for one occasion, as published.
NYSE_ADHOC = (
    D(1963, 11, 25), D(1968, 4, 9), D(1969, 2, 10), D(1969, 3, 31), D(1969, 7, 21), D(1972, 12, 28), D(1973, 1, 25), D(1977, 7, 14), D(1985, 9, 27), D(1994, 4, 27),
    D(2001, 9, 11), D(2001, 9, 12), D(2001, 9, 13), D(2001, 9, 14), D(2004, 6, 11), D(2007, 1, 2), D(2012, 10, 29), D(2012, 10, 30), D(2018, 12, 5), D(2025, 1, 9),
)
NYSE = HolidayCalendar("NYSE", (NEW_YEAR_MONDAY, MLK_1998, PRESIDENTS, WASHINGTON_OLD, GOOD_FRIDAY, MEMORIAL, MEMORIAL_OLD, JUNETEENTH_2022, INDEPENDENCE, LABOR, THANKSGIVING, CHRISTMAS), NYSE_ADHOC)
NYSE_EARLY = HolidayCalendar(
    "NYSE early closes",
    (
        Holiday("Day after Thanksgiving", 11, nth=(THU, 4), plus=1, start=D(1993, 1, 1)),
        Holiday("Christmas Eve", 12, 24, start=D(1993, 1, 1), days_of_week=(MON, TUE, WED, THU)),
        Holiday("Day before Independence Day", 7, 3, start=D(1995, 1, 1), days_of_week=(MON, TUE, THU)),
        Holiday("Wednesday before Independence Day", 7, 3, start=D(2013, 1, 1), days_of_week=(WED,)),
    ),
)
CME_EQUITY = HolidayCalendar("CME_Equity", (NEW_YEAR_MONDAY, GOOD_FRIDAY, CHRISTMAS))
CME_FULL = HolidayCalendar("CME", (NEW_YEAR_MONDAY, GOOD_FRIDAY, CHRISTMAS))
CME_EARLY = HolidayCalendar("CME early closes", (MLK_1998, PRESIDENTS, MEMORIAL, JUNETEENTH_2022, INDEPENDENCE, LABOR, THANKSGIVING, Holiday("Day after Thanksgiving", 11, nth=(THU, 4), plus=1), Holiday("Christmas Eve", 12, 24, days_of_week=(0, 1, 2, 3, 4))))
CME_PIT = HolidayCalendar("CME pit", (NEW_YEAR_MONDAY, MLK_1998, PRESIDENTS, GOOD_FRIDAY, MEMORIAL, JUNETEENTH_2022, INDEPENDENCE, LABOR, THANKSGIVING, CHRISTMAS))
NEW_YEAR_CHRISTMAS = HolidayCalendar("New Year and Christmas", (NEW_YEAR_MONDAY, CHRISTMAS))
UK = HolidayCalendar(
    "UK",
    (
        Holiday("New Year's Day", 1, 1, observance=next_monday), GOOD_FRIDAY, EASTER_MONDAY, Holiday("Early May bank holiday", 5, nth=(MON, 1), start=D(1978, 1, 1)), Holiday("Spring bank holiday", 5, nth=(MON, -1), start=D(1971, 1, 1)),
        Holiday("Summer bank holiday", 8, nth=(MON, -1), start=D(1971, 1, 1)), Holiday("Christmas Day", 12, 25, observance=next_monday), Holiday("Boxing Day", 12, 26, observance=next_monday_or_tuesday),
    ),
)
AUSTRALIA = HolidayCalendar("Australia", (Holiday("New Year's Day", 1, 1, observance=next_monday), Holiday("Australia Day", 1, 26, observance=next_monday), GOOD_FRIDAY, EASTER_MONDAY, Holiday("Anzac Day", 4, 25), Holiday("Sovereign's Birthday", 6, nth=(MON, 2)), Holiday("Christmas Day", 12, 25, observance=next_monday), Holiday("Boxing Day", 12, 26, observance=next_monday_or_tuesday)))
SIFMA = HolidayCalendar("SIFMA US", (NEW_YEAR_MONDAY, MLK, PRESIDENTS, GOOD_FRIDAY, MEMORIAL, JUNETEENTH_2022, INDEPENDENCE, LABOR, COLUMBUS, VETERANS, THANKSGIVING, CHRISTMAS))
CALENDARS = {c.name: c for c in (US_FEDERAL, NYSE, CME_EQUITY, CME_FULL, CME_PIT, UK, AUSTRALIA, SIFMA)}
