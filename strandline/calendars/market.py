"""Trading calendars: sessions with times that changed over the years, holidays and special days, as schedules.

A schedule is a table with one row for each session and a UTC instant for each kind of time (open, close, and breaks,
pre and post where the market has them): a few hundred rows a year, to broadcast.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import holidays as H
from .busday import BusinessDays

TIMES = ("pre", "open", "break_start", "break_end", "close", "post")


@dataclass(frozen=True)
class At:
    """A local time of day, on the day `days` from the session's, from a date on."""

    time: dt.time
    days: int = 0
    since: dt.date | None = None


@dataclass(frozen=True)
class MarketCalendar:
    """times: for each kind the times of day in turn; early: days that close at early_close; special: one-off times by kind and day."""

    name: str
    tz: str
    times: dict[str, tuple[At, ...]]
    aliases: tuple[str, ...] = ()
    weekmask: str = "1111100"
    regular: H.HolidayCalendar = field(default_factory=lambda: H.HolidayCalendar("none"))
    early: H.HolidayCalendar = field(default_factory=lambda: H.HolidayCalendar("none"))
    early_close: dt.time | None = None
    special: dict[str, dict[dt.date, dt.time]] = field(default_factory=dict)

    def get_time(self, kind: str, on: dt.date | None = None) -> At | None:
        """The time in force on a date, the latest by default."""
        found = [a for a in self.times.get(kind, ()) if on is None or a.since is None or a.since <= on]
        return max(found, key=lambda a: a.since or dt.date.min, default=None)

    def add_time(self, kind: str, at: At | list[At]) -> MarketCalendar:
        if kind in self.times:
            raise ValueError(f"{kind} exists")
        return replace(self, times={**self.times, kind: tuple(at) if isinstance(at, list) else (at,)})

    def change_time(self, kind: str, at: At | list[At]) -> MarketCalendar:
        return self.remove_time(kind).add_time(kind, at)

    def remove_time(self, kind: str) -> MarketCalendar:
        if kind not in self.times:
            raise KeyError(kind)
        return replace(self, times={k: v for k, v in self.times.items() if k != kind})

    @property
    def has_break(self) -> bool:
        return "break_start" in self.times

    def business_days(self, start: dt.date, end: dt.date) -> BusinessDays:
        return BusinessDays(self.weekmask, tuple(self.regular.holidays(start, end)))

    def valid_days(self, spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
        return self.business_days(start, end).table(spark, start, end).where("is_busday").select("date")

    def _instant(self, day: Column, kind: str) -> Column:
        """UTC instant of a kind of time on a session's day, by the time in force then."""

        def made(a: At) -> Column:
            return self._utc(F.concat(F.date_add(day, a.days).cast("string"), F.lit(f" {a.time.isoformat()}")))

        out = F.lit(None).cast("timestamp")
        for a in sorted(self.times[kind], key=lambda a: a.since or dt.date.min):
            out = made(a) if a.since is None else F.when(day >= F.lit(a.since), made(a)).otherwise(out)
        return out

    def _utc(self, text: Column) -> Column:
        """The instant of a local date and time, whatever the session's zone."""
        utc = F.convert_timezone(F.lit(self.tz), F.lit("UTC"), F.to_timestamp_ntz(text))
        return F.to_timestamp(F.concat(utc.cast("string"), F.lit("Z")))

    def special_dates(self, kind: str, start: dt.date, end: dt.date) -> dict[dt.date, dt.time]:
        out = dict.fromkeys(self.early.holidays(start, end), self.early_close) if kind == "close" and self.early_close else {}
        off = set(self.regular.holidays(start, end))
        out |= self.special.get(kind, {})
        return {d: t for d, t in sorted(out.items()) if start <= d <= end and d not in off}

    def schedule(self, spark: SparkSession, start: dt.date, end: dt.date, kinds: tuple[str, ...] | None = None, force_special: bool = True) -> DataFrame:
        """(date, one instant for each kind). Special closes and opens replace the regular ones and clip the other times."""
        kinds = kinds or tuple(k for k in TIMES if k in self.times)
        out = self.valid_days(spark, start, end)
        out = out.select("date", *[self._instant(F.col("date"), k).alias(k) for k in kinds])
        for kind, clip in (("open", F.greatest), ("close", F.least)):
            days = self.special_dates(kind, start, end)
            if not days or kind not in self.times:
                continue
            rows = [(d, f"{d} {t.isoformat()}") for d, t in days.items()]
            table = spark.createDataFrame(rows, "date date, at string").select("date", self._utc(F.col("at")).alias("__at"))
            out = out.join(F.broadcast(table), "date", "left")
            if force_special:
                out = out.select("date", *[(F.coalesce("__at", k) if k == kind else clip(k, F.coalesce("__at", k))).alias(k) for k in kinds])
            elif kind in kinds:
                out = out.withColumn(kind, F.coalesce("__at", kind)).drop("__at")
            else:
                out = out.drop("__at")
        return out.orderBy("date")

    def date_range_htf(self, spark: SparkSession, start: dt.date, periods: int) -> DataFrame:
        """The first `periods` sessions from start on."""
        end = start + dt.timedelta(days=7 * (periods // max(1, self.weekmask.count("1")) + 4) + periods // 10)
        return self.valid_days(spark, start, end).orderBy("date").limit(periods)


def open_at_time(times: DataFrame, column: str, schedule: DataFrame, include_close: bool = False) -> DataFrame:
    """times with is_open: whether the instant is in a session (and not in its break).

    Sessions are listed under the days that they touch; a schedule has a row for each day, so the lists are broadcast and
    no row of times is moved.
    """
    at = F.col(column).cast("timestamp")
    parts = [c for c in ("open", "close", "break_start", "break_end") if c in schedule.columns]
    pieces = schedule.select(F.explode(F.sequence(F.to_date("open"), F.to_date("close"))).alias("__day"), F.struct(*parts).alias("s"))
    days = F.broadcast(pieces.groupBy("__day").agg(F.collect_list("s").alias("__sessions")))

    def inside(s: Column) -> Column:
        here = (at >= s["open"]) & ((at <= s["close"]) if include_close else (at < s["close"]))
        return here & ~F.coalesce((at >= s["break_start"]) & (at < s["break_end"]), F.lit(False)) if "break_start" in parts else here

    flagged = times.join(days, F.to_date(at) == F.col("__day"), "left")
    return flagged.select(*times.columns, F.coalesce(F.exists("__sessions", inside), F.lit(False)).alias("is_open"))


def merge_schedules(schedules: list[DataFrame], outer: bool = True) -> DataFrame:
    """Days of any (outer) or all markets: from the first open to the last close, or the time that all are open. Breaks go."""
    out = schedules[0].select("date", "open", "close")
    for s in schedules[1:]:
        b = s.select("date", F.col("open").alias("__o"), F.col("close").alias("__c"))
        out = out.join(b, "date", "full_outer" if outer else "inner")
        first, last = (F.least, F.greatest) if outer else (F.greatest, F.least)
        out = out.select("date", first("open", "__o").alias("open"), last("close", "__c").alias("close"))
    return out.orderBy("date")


T = dt.time
NY, CHI = "America/New_York", "America/Chicago"


def _times(open_: At | tuple[At, ...], close: At | tuple[At, ...], start: dt.time | None = None, end: dt.time | None = None, start_days: int = 0) -> dict[str, tuple[At, ...]]:
    one = lambda x: x if isinstance(x, tuple) else (x,)
    out = {"open": one(open_), "close": one(close)}
    return out | ({"break_start": (At(start, start_days),), "break_end": (At(end, start_days),)} if start else {})


# Regular sessions of the exchanges, in local time, as they publish them.
CALENDARS = (
    MarketCalendar("NYSE", NY, {"pre": (At(T(4)),), "open": (At(T(10)), At(T(9, 30), 0, dt.date(1985, 1, 1))), "close": (At(T(15)), At(T(15, 30), 0, dt.date(1952, 9, 29)), At(T(16), 0, dt.date(1974, 1, 1))), "post": (At(T(20)),)}, ("stock", "NASDAQ", "BATS", "DJIA", "DOW"), regular=H.NYSE, early=H.NYSE_EARLY, early_close=T(13)),
    MarketCalendar("CME_Equity", CHI, _times(At(T(17), -1), At(T(16)), T(15, 15), T(15, 30)), ("CBOT_Equity",), regular=H.CME_EQUITY, early=H.CME_EARLY, early_close=T(12)),
    MarketCalendar("CME_Agriculture", CHI, _times(At(T(17, 1), -1), At(T(17))), ("CBOT_Agriculture", "COMEX_Agriculture", "NYMEX_Agriculture"), regular=H.CME_PIT, early=H.CME_EARLY, early_close=T(12)),
    MarketCalendar("CME_Bond", CHI, _times(At(T(17), -1), At(T(16))), ("CME_Rate", "CBOT_Rate", "CBOT_Bond", "CME_InterestRate", "CBOT_InterestRate"), regular=H.CME_FULL, early=H.CME_EARLY, early_close=T(12)),
    MarketCalendar("CFE", CHI, _times(At(T(8, 30)), At(T(15, 15))), ("CBOE_Futures",), regular=H.NYSE, early=H.NYSE_EARLY, early_close=T(12, 15)),
    MarketCalendar("CBOE_Equity_Options", CHI, _times(At(T(8, 30)), At(T(15))), regular=H.NYSE, early=H.NYSE_EARLY, early_close=T(12)),
    MarketCalendar("CBOE_Index_Options", CHI, _times(At(T(8, 30)), At(T(15, 15))), regular=H.NYSE, early=H.NYSE_EARLY, early_close=T(12, 15)),
    MarketCalendar("CMEGlobex_FX", CHI, _times(At(T(17), -1), At(T(16))), ("CME FX", "CME_Currency"), regular=H.NEW_YEAR_CHRISTMAS, early=H.CME_EARLY, early_close=T(12)),
    MarketCalendar("CME Globex Crypto", CHI, _times(At(T(17), -1), At(T(16)), T(16), T(17)), ("CME Globex Cryptocurrencies",), regular=H.CME_FULL, early=H.CME_EARLY, early_close=T(12)),
    MarketCalendar("CME Globex Equity", CHI, _times(At(T(17), -1), At(T(16))), ("CME Globex Equities",), regular=H.CME_EQUITY, early=H.CME_EARLY, early_close=T(12)),
    MarketCalendar("CMEGlobex_Livestock", CHI, _times(At(T(8, 30)), At(T(13, 5))), ("CMEGlobex_Live_Cattle", "CMEGlobex_Lean_Hog"), regular=H.CME_PIT, early=H.CME_EARLY, early_close=T(12, 5)),
    MarketCalendar("CMEGlobex_Grains", CHI, _times(At(T(19), -1), At(T(13, 20)), T(7, 45), T(8, 30)), ("CMEGlobex_Oilseeds", "CMEGlobex_GrainsAndOilseeds"), regular=H.CME_PIT, early=H.CME_EARLY, early_close=T(12, 5)),
    MarketCalendar("CME Globex Fixed Income", CHI, _times(At(T(18), -1), At(T(17))), ("CME Globex Interest Rate Products",), regular=H.CME_FULL, early=H.CME_EARLY, early_close=T(12)),
    MarketCalendar("CMEGlobex_EnergyAndMetals", CHI, _times(At(T(17), -1), At(T(16))), ("CMEGlobex_Energy", "CMEGlobex_Metals", "CMEGlobex_CrudeOil", "CMEGlobex_Gold", "CMEGlobex_NaturalGas"), regular=H.CME_FULL, early=H.CME_EARLY, early_close=T(12)),
    MarketCalendar("ICE", NY, _times(At(T(20, 1), -1), At(T(18))), ("ICEUS", "NYFE"), regular=H.CME_FULL, early=H.NYSE_EARLY, early_close=T(13)),
    MarketCalendar("FX", NY, _times(At(T(17), -1), At(T(17))), ("Forex",), regular=H.NEW_YEAR_CHRISTMAS),
    MarketCalendar("Crypto", "UTC", _times(At(T(0)), At(T(0), 1)), ("BTC", "Cryptocurrency"), weekmask="1111111"),
)


def get_calendar(name: str) -> MarketCalendar:
    for c in CALENDARS:
        if name in (c.name, *c.aliases):
            return c
    raise KeyError(f"no calendar {name!r}")
