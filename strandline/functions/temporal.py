"""Temporal columns. Naive times are timestamp_ntz; instants are timestamp, read in the zone given (UTC by default).

The session time zone is expected to be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import java_pattern

MICROS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000}


def micros(c: Column) -> Column:
    """Microseconds since 1970 of the wall clock (timestamp_ntz) or instant."""
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def wall_micros(c: Column) -> Column:
    """Microseconds since 1970 of a wall clock (timestamp_ntz), whatever the session's zone."""
    c = c.cast("timestamp_ntz")
    second = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(F.to_date(c)).cast("long") * MICROS["day"] + F.hour(c).cast("long") * MICROS["hour"] + F.minute(c).cast("long") * MICROS["minute"] + second


def from_wall_micros(c: Column) -> Column:
    """The wall clock so many microseconds after 1970, whatever the session's zone."""
    day = F.date_from_unix_date(((c - F.pmod(c, F.lit(MICROS["day"]))) / MICROS["day"]).cast("int"))
    rest = F.pmod(c, F.lit(MICROS["day"]))
    seconds = (rest.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def local(c: Column, tz: str = "UTC") -> Column:
    """Wall clock of an instant in a zone."""
    return F.from_utc_timestamp(c.cast("timestamp"), tz).cast("timestamp_ntz")


def year(c: Column) -> Column:
    return F.year(c)


def quarter(c: Column) -> Column:
    return F.quarter(c)


def month(c: Column) -> Column:
    return F.month(c)


def day(c: Column) -> Column:
    return F.dayofmonth(c)


def hour(c: Column) -> Column:
    return F.hour(c)


def minute(c: Column) -> Column:
    return F.minute(c)


def second(c: Column) -> Column:
    return F.second(c)


def millisecond(c: Column) -> Column:
    return F.floor(F.pmod(micros(c), F.lit(1_000_000)) / 1000).cast("int")


def microsecond(c: Column) -> Column:
    return F.pmod(micros(c), F.lit(1000)).cast("int")


def nanosecond(c: Column) -> Column:
    """Always 0: Spark keeps microseconds."""
    return F.when(c.isNotNull(), F.lit(0))


def subsecond(c: Column) -> Column:
    return F.pmod(micros(c), F.lit(1_000_000)) / 1e6


def day_of_week(c: Column, count_from_zero: bool = True, week_start: int = 1) -> Column:
    """Days since week_start (1 Monday to 7 Sunday), from 0 or 1."""
    return F.pmod(F.weekday(c) - F.lit(week_start - 1), F.lit(7)) + F.lit(0 if count_from_zero else 1)


def day_of_year(c: Column) -> Column:
    return F.dayofyear(c)


def iso_week(c: Column) -> Column:
    return F.weekofyear(c)


def iso_year(c: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), c)


def iso_calendar(c: Column) -> Column:
    return F.struct(iso_year(c).alias("iso_year"), iso_week(c).alias("iso_week"), (F.weekday(c) + 1).alias("iso_day_of_week"))


def week(c: Column, monday_start: bool = True, count_from_zero: bool = False, first_week_full: bool = False) -> Column:
    """Week of the year: weeks start on Monday or Sunday; week 1 holds 4 January (or is the first full one); with count_from_zero days before it are week 0."""
    back = F.weekday(c) if monday_start else F.dayofweek(c) - 1
    start = F.date_sub(F.to_date(c), back)
    day = F.date_add(start, 0 if first_week_full else 3)
    number = F.floor((F.dayofyear(day) - 1) / 7).cast("int") + 1
    early = F.year(day) < F.year(c)
    return F.when(early, 0).otherwise(number) if count_from_zero else number


def us_week(c: Column) -> Column:
    """Weeks from Sunday; week 1 has at least four days of the year."""
    return week(c, monday_start=False)


def us_year(c: Column) -> Column:
    return F.year(F.date_add(F.date_sub(F.to_date(c), F.dayofweek(c) - 1), 3))


def is_leap_year(c: Column) -> Column:
    y = F.year(c)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def is_dst(c: Column, tz: str) -> Column:
    """Whether an instant falls into a zone's summer time: its offset exceeds that zone's smaller of January and July."""
    offset = lambda t: micros(local(t, tz)) - micros(t.cast("timestamp"))
    t = c.cast("timestamp")
    points = [F.make_timestamp(F.year(t), F.lit(m), F.lit(1), F.lit(12), F.lit(0), F.lit(0)) for m in (1, 7)]
    return offset(t) > F.least(*[offset(p) for p in points])


def year_month_day(c: Column) -> Column:
    return F.struct(F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day"))


def floor(c: Column, unit: str = "day", multiple: int = 1, week_starts_monday: bool = True) -> Column:
    """Down to a multiple of the unit, counted from 1970 (weeks from a Monday or Sunday, months and up from year 0)."""
    t = c.cast("timestamp")
    if unit in ("month", "quarter", "year"):
        span = {"month": 1, "quarter": 3, "year": 12}[unit] * multiple
        if unit == "year":
            m0 = F.year(t) * 12
        else:
            m0 = F.year(t) * 12 + F.month(t) - 1
        m = m0 - F.pmod(m0, F.lit(span))
        return F.make_timestamp_ntz(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    step = MICROS[unit] * multiple
    origin = (-3 if week_starts_monday else -4) * MICROS["day"] if unit == "week" else 0
    u = micros(c)
    return from_micros(u - F.pmod(u - F.lit(origin), F.lit(step)))


def ceil(c: Column, unit: str = "day", multiple: int = 1, week_starts_monday: bool = True) -> Column:
    """Up to the next multiple, unless already on one."""
    low = floor(c, unit, multiple, week_starts_monday)
    return F.when(micros(low) == micros(c), low).otherwise(_add(low, unit, multiple))


def round_to(c: Column, unit: str = "day", multiple: int = 1, week_starts_monday: bool = True) -> Column:
    """To the nearer multiple; half way goes up."""
    low = floor(c, unit, multiple, week_starts_monday)
    high = _add(low, unit, multiple)
    return F.when(2 * micros(c) < micros(low) + micros(high), low).otherwise(high)


def _add(c: Column, unit: str, n: int) -> Column:
    if unit in ("month", "quarter", "year"):
        months = {"month": 1, "quarter": 3, "year": 12}[unit] * n
        return F.add_months(F.to_date(c), months).cast("timestamp_ntz")
    return from_micros(micros(c) + F.lit(MICROS[unit] * n))


def normalize(c: Column) -> Column:
    return floor(c, "day")


def strftime(c: Column, fmt: str) -> Column:
    return F.date_format(c, java_pattern(fmt))


def _floor_div(c: Column, n: int) -> Column:
    """Exact floor division of longs."""
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("long")


def _count(unit: str, c: Column) -> Column:
    if unit == "year":
        return F.year(c).cast("long")
    if unit == "quarter":
        return (F.year(c) * 4 + F.quarter(c)).cast("long")
    if unit == "month":
        return (F.year(c) * 12 + F.month(c)).cast("long")
    if unit == "week":
        return _floor_div(micros(c) + F.lit(3 * MICROS["day"]), MICROS["week"])
    return _floor_div(micros(c), MICROS[unit])


def between(start: Column, end: Column, unit: str) -> Column:
    """How many boundaries of the unit (year ... microsecond) lie between start and end; negative backwards."""
    return _count(unit, end) - _count(unit, start)


def nanoseconds_between(start: Column, end: Column) -> Column:
    return between(start, end, "microsecond") * 1000


def month_interval_between(start: Column, end: Column) -> Column:
    return F.make_ym_interval(F.lit(0), between(start, end, "month").cast("int"))


def day_time_interval_between(start: Column, end: Column) -> Column:
    """Struct of whole days between the dates and milliseconds between the times of day."""
    days = between(start, end, "day").cast("int")
    time = lambda c: F.pmod(micros(c), F.lit(MICROS["day"]))
    return F.struct(days.alias("days"), F.floor((time(end) - time(start)) / 1000).cast("int").alias("milliseconds"))


def month_day_nano_interval_between(start: Column, end: Column) -> Column:
    time = lambda c: F.pmod(micros(c), F.lit(MICROS["day"]))
    return F.struct(between(start, end, "month").cast("int").alias("months"), (F.dayofmonth(end) - F.dayofmonth(start)).alias("days"), ((time(end) - time(start)) * 1000).alias("nanoseconds"))


AMBIGUOUS, NONEXISTENT = ("raise", "earliest", "latest", "nat"), ("raise", "shift_forward", "shift_backward", "nat")


def tz_localize(c: Column, tz: str, ambiguous: str = "raise", nonexistent: str = "raise") -> Column:
    """The instant at which a zone's clocks show the naive time c.

    A time that the clocks show twice takes the earlier or later instant, one that they skip the first instant
    after or the last microsecond before the gap; `raise` fails the job, `nat` gives null. tz '' returns c as it is.
    """
    if tz == "":
        return c.cast("timestamp_ntz")
    if ambiguous not in AMBIGUOUS or nonexistent not in NONEXISTENT:
        raise ValueError("unknown policy")
    day = F.lit(MICROS["day"])
    wall = micros(c)
    offset = lambda u: micros(local(F.timestamp_micros(u), tz)) - u
    before, after = offset(wall - day), offset(wall + day)  # the offsets in force around
    early, late = wall - F.greatest(before, after), wall - F.least(before, after)
    ok_early, ok_late = early + offset(early) == wall, late + offset(late) == wall
    error = lambda what: F.raise_error(F.concat(F.lit(f"{what} time in {tz}: "), c.cast("string"))).cast("long")
    null = F.lit(None).cast("long")
    twice = {"earliest": early, "latest": late, "nat": null}.get(ambiguous)
    # in a gap the clocks jump by after - before at the instant at which the wall time would be reached under neither
    jump = _gap_instant(wall, before, after, tz)
    skipped = {"shift_forward": jump, "shift_backward": jump - 1, "nat": null}.get(nonexistent)
    both = ok_early & ok_late & (early != late)
    out = (
        F.when(wall.isNull(), null)
        .when(both, error("ambiguous") if twice is None else twice)
        .when(ok_early, early)
        .when(ok_late, late)
        .otherwise(error("nonexistent") if skipped is None else skipped)
    )
    return F.timestamp_micros(out)


def _gap_instant(wall: Column, before: Column, after: Column, tz: str) -> Column:
    """The instant of a forward jump near wall: found on the quarter hours between the two readings."""
    quarter = 15 * MICROS["minute"]
    first = _floor_div(wall - F.greatest(before, after), quarter) * quarter
    steps = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: first + k.cast("long") * quarter)
    ready = F.filter(steps, lambda u: micros(F.from_utc_timestamp(F.timestamp_micros(u), tz)) - u >= F.greatest(before, after))
    return F.array_min(ready)


def tz_convert(c: Column, tz: str) -> Column:
    """An instant stays; with tz '' its UTC wall clock as a naive time."""
    return c.cast("timestamp") if tz else c.cast("timestamp").cast("timestamp_ntz")


def replace_tz(c: Column, tz: str) -> Column:
    """The stored value read as UTC under another label."""
    return c.cast("timestamp")


def assume_timezone(c: Column, tz: str, ambiguous: str = "raise", nonexistent: str = "raise") -> Column:
    return tz_localize(c, tz, ambiguous, nonexistent)


def local_timestamp(c: Column, tz: str) -> Column:
    return local(c, tz)
