"""Registered queries, one or more for each operator family, and the DuckDB SQL that each must agree with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..calendars.busday import BusinessDays
from ..calendars.market import get_calendar, open_at_time
from ..frame import Frame
from ..functions import logic as L
from ..functions import math as M
from ..functions import offsets as O
from ..functions import strings as S
from ..functions import temporal as T
from ..index import Index
from ..operators import aggregate, combine, ewm, resample, select, windows
from ..operators.position import with_position
from ..sources import files, generate
from ..storage import shared_path
from .sql import query

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *extra: str) -> Frame:
    df = table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "value", *extra)
    return Frame(df, "ts", ["ts", "event_id"], ["event_type"])


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
LINE_SQL = ", ".join(LINE)
NTZ = "timestamp_ntz"

# bars and resampling


@register("resample_ohlcv_1h", "select event_type, date_trunc('hour', ts) as bucket, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, last(value order by ts, event_id) as close, round(sum(value), 6) as volume from events group by 1, 2")
def ohlcv_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = dict.fromkeys(("open", "high", "low", "close", "volume"), "value")
    bars = events(spark, sf_dir).ohlcv("1h", columns=names, origin="epoch")
    return bars.withColumnRenamed("ts", "bucket").withColumn("volume", r6("volume"))


def _tick(closed: str, label: str, origin: str, minutes: int, offset: int = 0) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = resample.Resample(f"{minutes}min", closed, label, origin, dt.timedelta(minutes=offset))
        return resample.resample(table(spark, sf_dir, "events"), "ts", o, name="bucket").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))

    f = minutes * 60_000_000
    at = {"epoch": "0::bigint", "start": "(select min(epoch_us(ts)) from events)", "start_day": "(select epoch_us(date_trunc('day', min(ts))) from events)"}
    low = "(select min(epoch_us(ts)) from events)"
    last = {"end": "(select max(epoch_us(ts)) from events)", "end_day": "(select -((-max(epoch_us(ts))) // 86400000000) * 86400000000 from events)"}
    if origin in last:
        top = "(select max(epoch_us(ts)) from events)" if origin == "end" else "(select case when max(epoch_us(ts)) % 86400000000 = 0 then max(epoch_us(ts)) else (max(epoch_us(ts)) // 86400000000 + 1) * 86400000000 end from events)"
        at[origin] = f"({top} - (({top} - {low}) // {f} + {1 if closed == 'left' else 0}) * {f})"
    o = f"({at[origin]} + {offset * 60_000_000})"
    pm = lambda x: f"((({x}) % {f} + {f}) % {f})"
    start = f"t - {pm(f't - {o}')}" if closed == "left" else f"t + {pm(f'{o} - t')} - {f}"
    add = f" + {f}" if label == "right" else ""
    sql = f"select make_timestamp({start}{add}) as bucket, count(*) as n, round(sum(value), 6) as total from (select epoch_us(ts) as t, value from events) group by 1"
    return run, sql


for _closed, _label, _origin, _minutes, _offset in (("left", "left", "start_day", 17, 0), ("right", "right", "start_day", 60, 0), ("left", "right", "epoch", 420, 2), ("right", "left", "start", 37, 0), ("left", "left", "end", 90, 0), ("right", "right", "end_day", 50, 5)):
    _run, _sql = _tick(_closed, _label, _origin, _minutes, _offset)
    register(f"resample_tick_{_closed}_{_label}_{_origin}", _sql)(_run)


def _calendar(freq: str, closed: str | None = None, label: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = resample.Resample(freq, closed, label)
        return resample.resample(table(spark, sf_dir, "orders"), "o_orderdate", o, name="bucket").agg(F.count("*").alias("n"), r6(F.sum("o_totalprice")).alias("total"), r6(F.avg("o_totalprice")).alias("mean"))

    return run


_CAL = "select {b} as bucket, count(*) as n, round(sum(o_totalprice), 6) as total, round(avg(o_totalprice), 6) as mean from orders group by 1"
register("resample_month_end", _CAL.format(b="last_day(o_orderdate)::timestamp"))(_calendar("ME"))
register("resample_month_start", _CAL.format(b="date_trunc('month', o_orderdate)::timestamp"))(_calendar("MS"))
register("resample_quarter_start", _CAL.format(b="date_trunc('quarter', o_orderdate)::timestamp"))(_calendar("QS"))
register("resample_quarter_end", _CAL.format(b="(date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day)::timestamp"))(_calendar("QE"))
register("resample_year_end", _CAL.format(b="make_timestamp(year(o_orderdate), 12, 31, 0, 0, 0.0)"))(_calendar("YE"))
register("resample_year_start", _CAL.format(b="date_trunc('year', o_orderdate)::timestamp"))(_calendar("YS"))
register("resample_week_sun", _CAL.format(b="(date_trunc('week', o_orderdate) + interval 6 day)::timestamp"))(_calendar("W"))
register("resample_week_left_label", _CAL.format(b="(date_trunc('week', o_orderdate) - interval 1 day)::timestamp"))(_calendar("W", label="left"))
register("resample_business_day", _CAL.format(b="(date_trunc('day', o_orderdate) - to_days(greatest(isodow(o_orderdate)::int - 5, 0)))::timestamp"))(_calendar("B"))


@register("resample_fill_gaps_all", "with b as (select event_type, date_trunc('minute', ts) as bucket, count(*) as n from events group by 1, 2), g as (select event_type, unnest(range(min(bucket), max(bucket) + interval 1 minute, interval 1 minute)) as bucket from b group by 1) select g.event_type, g.bucket, b.n from g left join b using (event_type, bucket)")
def fill_gaps_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = resample.Resample("1min", origin="epoch")
    bars = resample.resample(table(spark, sf_dir, "events"), "ts", o, ["event_type"], "bucket").agg(F.count("*").alias("n"))
    return resample.fill_gaps(bars, "bucket", o, ["event_type"])


@register("resample_tz_day", "select make_timestamp(epoch_us(timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', ts)))))) as bucket, count(*) as n from events group by 1")
def resample_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "events"), "ts", resample.Resample("D", origin="epoch", tz="America/New_York"), name="bucket").agg(F.count("*").alias("n"))


# windows

_W = "partition by event_type order by ts, event_id"
_NULLED = "(select *, case when event_id % 7 = 0 then null else value end as x from events)"


def _with_nulls(spark: SparkSession, sf_dir: str) -> Frame:
    df = table(spark, sf_dir, "events").select("ts", "event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))
    return Frame(df, "ts", ["ts", "event_id"], ["event_type"])


def _rolling(name: str, agg: str, frame: str, least: int, sql_agg: str, **kw) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _with_nulls(spark, sf_dir).rolling(agg, **kw)
        return out.df.select("event_type", "ts", "event_id", r6(F.col("x").cast("double")).alias("x"))

    enough = f"case when count(x) over w >= {least} then round({sql_agg}, 6) end"
    register(name, f"select event_type, ts, event_id, {enough} as x from {_NULLED} window w as ({_W} {frame})")(run)


_rolling("rolling_sum_closed_right", "sum", "rows between 4 preceding and current row", 2, "sum(x) over w", size=5, min_periods=2)
_rolling("rolling_sum_closed_left", "sum", "rows between 5 preceding and 1 preceding", 2, "sum(x) over w", size=5, min_periods=2, closed="left")
_rolling("rolling_sum_closed_both", "sum", "rows between 5 preceding and current row", 2, "sum(x) over w", size=5, min_periods=2, closed="both")
_rolling("rolling_sum_closed_neither", "sum", "rows between 4 preceding and 1 preceding", 2, "sum(x) over w", size=5, min_periods=2, closed="neither")
_rolling("rolling_mean_center", "mean", "rows between 3 preceding and 3 following", 1, "avg(x) over w", size=7, min_periods=1, center=True)
_rolling("rolling_std_min_periods", "stddev", "rows between 9 preceding and current row", 5, "stddev_samp(x) over w", size=10, min_periods=5)
_rolling("rolling_var_pop", "variance", "rows between 9 preceding and current row", 5, "var_pop(x) over w", size=10, min_periods=5, ddof=0)
_rolling("rolling_min", "min", "rows between 19 preceding and current row", 20, "min(x) over w", size=20)
_rolling("rolling_max", "max", "rows between 19 preceding and current row", 1, "max(x) over w", size=20, min_periods=1)
_rolling("rolling_quantile", "quantile", "rows between 8 preceding and current row", 3, "quantile_cont(x, 0.25) over w", size=9, min_periods=3, q=0.25)


@register("rolling_step", f"select event_type, ts, event_id, x from (select event_type, ts, event_id, case when count(value) over w >= 3 then round(sum(value) over w, 6) end as x, row_number() over ({_W}) - 1 as k from events window w as ({_W} rows between 2 preceding and current row)) where k % 4 = 0")
def rolling_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).rolling("sum", 3, step=4)
    return out.df.select("event_type", "ts", "event_id", r6("value").alias("x"))


@register("rolling_unkeyed", "select event_id, ts, round(avg(value) over (order by ts, event_id rows between 99 preceding and current row), 6) as x from events")
def rolling_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "events").select("ts", "event_id", "value"), "ts", ["ts", "event_id"])
    return f.rolling("mean", 100, min_periods=1).df.select("event_id", "ts", r6("value").alias("x"))


@register("cumulative_unkeyed", "select event_id, ts, round(sum(value) over (order by ts, event_id), 4) as total, max(value) over (order by ts, event_id) as top from events")
def cumulative_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("ts", "event_id", F.col("value").alias("total"), F.col("value").alias("top"))
    f = Frame(df, "ts", ["ts", "event_id"])
    out = f.cumulative("sum", ["total"]).cumulative("max", ["top"])
    return out.df.select("event_id", "ts", F.round("total", 4).alias("total"), "top")


@register("rolling_corr", f"select event_type, ts, event_id, case when count(x) over w >= 10 and isfinite(c) then round(c, 4) end as corr, case when count(x) over w >= 10 then round(covar_samp(value, y) over w, 4) end as cov from (select *, value as x, (event_id % 11)::double as y, corr(value, (event_id % 11)::double) over ({_W} rows between 29 preceding and current row) as c from events) window w as ({_W} rows between 29 preceding and current row)")
def rolling_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events(spark, sf_dir)
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    spec = windows.Rolling(30, 10)
    y = (F.col("event_id") % 11).cast("double")
    return f.df.select("event_type", "ts", "event_id", F.round(windows.agg("corr", F.col("value"), spec, w, other=y), 4).alias("corr"), F.round(windows.agg("cov", F.col("value"), spec, w, other=y), 4).alias("cov"))


@register("expanding_sum", f"select event_type, ts, event_id, case when count(x) over w >= 3 then round(sum(x) over w, 4) end as x from {_NULLED} window w as ({_W} rows unbounded preceding)")
def expanding_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nulls(spark, sf_dir).expanding("sum", min_periods=3).df.select("event_type", "ts", "event_id", F.round("x", 4).alias("x"))


for _name, _f in (("sum", "sum"), ("max", "max"), ("min", "min"), ("mean", "avg")):

    def _cumulative(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        return _with_nulls(spark, sf_dir).cumulative(name).df.select("event_type", "ts", "event_id", r6("x").alias("x"))

    register(f"cumulative_{_name}", f"select event_type, ts, event_id, case when x is not null then round({_f}(x) over ({_W} rows unbounded preceding), 6) end as x from {_NULLED}")(_cumulative)


@register("cumulative_prod", f"select event_type, ts, event_id, round(product(1 + value / 1e6) over ({_W} rows unbounded preceding), 6) as x from events")
def cumulative_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_type", "ts", "event_id", r6(windows.cumulative("prod", 1 + F.col("value") / 1e6, w)).alias("x"))


for _name, _sql in (("ffill", f"last_value(x ignore nulls) over ({_W} rows unbounded preceding)"), ("bfill", f"first_value(x ignore nulls) over ({_W} rows between current row and unbounded following)")):

    def _fill(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        return getattr(_with_nulls(spark, sf_dir), name)().df.select("event_type", "ts", "event_id", "x")

    register(_name, f"select event_type, ts, event_id, {_sql} as x from {_NULLED}")(_fill)


@register("rolling_apply", f"select event_type, ts, event_id, case when count(x) over w >= 2 then round(max(x) over w - min(x) over w, 6) end as x from {_NULLED} window w as ({_W} rows between 5 preceding and current row)")
def rolling_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _with_nulls(spark, sf_dir).rolling_apply(lambda v: max(v) - min(v), "x", 6, "spread", 2)
    return out.df.select("event_type", "ts", "event_id", F.when(~F.isnan("spread"), r6("spread")).alias("x"))


@register("index_lookups", "select (select count(*) from events where event_id < 400) as at, (select min(event_id) from events) as low, (select max(event_id) from events) as high, 300 as deleted")
def index_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index(table(spark, sf_dir, "events").select("event_id"), "event_id")
    gone = index.iloc(slice(300, 301)).labels.select(F.col("event_id").cast("int").alias("deleted"))
    return select.searchsorted(index.df, "event_id", 400).select(F.col("position").alias("at"), F.lit(index.min()).alias("low"), F.lit(index.max()).alias("high")).join(gone)


@register("business_days", "select o_orderkey, (select count(*) from range(0, 3000) t(k) where o_orderdate::date + k::int < date '1998-08-02' and isodow(o_orderdate::date + k::int) < 6) as n from orders where o_orderdate > timestamp '1995-01-01'")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = BusinessDays().table(spark, dt.date(1995, 1, 1), dt.date(1998, 8, 2))
    end = days.where("date = date'1998-08-01'").select(F.col("ordinal").alias("last"))
    orders = table(spark, sf_dir, "orders").where("o_orderdate > timestamp_ntz'1995-01-01'")
    at = days.select(F.col("date").alias("d"), (F.col("ordinal") - F.col("is_busday").cast("int")).alias("before"))
    joined = orders.join(F.broadcast(at), F.to_date("o_orderdate") == F.col("d"), "left").join(F.broadcast(end))
    return joined.select("o_orderkey", F.greatest(F.coalesce(F.col("last") - F.col("before"), F.lit(0)), F.lit(0)).cast("long").alias("n"))


@register("shift_diff_pct", f"select event_type, ts, event_id, lag(value, 2) over w as before, lead(value) over w as after, round(value - lag(value) over w, 6) as diff, round(case when lag(value) over w <> 0 then (value - lag(value) over w) / lag(value) over w end, 6) as pct from events window w as ({_W})")
def shift_diff_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = Window.partitionBy("event_type").orderBy("ts", "event_id"), F.col("value")
    return table(spark, sf_dir, "events").select("event_type", "ts", "event_id", windows.shift(v, 2, w).alias("before"), windows.shift(v, -1, w).alias("after"), r6(windows.diff(v, 1, w)).alias("diff"), r6(windows.pct_change(v, 1, w)).alias("pct"))


@register("shift_unkeyed", "select event_id, ts, lag(value, 3) over (order by ts, event_id) as value from events")
def shift_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frame(table(spark, sf_dir, "events").select("ts", "event_id", "value"), "ts", ["ts", "event_id"]).shift(3).df.select("event_id", "ts", "value")


@register("ranking", f"select event_id, row_number() over ({_W}) as rn, rank() over (partition by event_type order by value) as rk, dense_rank() over (partition by event_type order by value) as dr, ntile(4) over ({_W}) as nt from events")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = Window.partitionBy("event_type").orderBy("ts", "event_id"), Window.partitionBy("event_type").orderBy("value")
    long = lambda c: c.cast("long")
    return table(spark, sf_dir, "events").select("event_id", long(windows.ranking("row_number", w)).alias("rn"), long(windows.ranking("rank", v)).alias("rk"), long(windows.ranking("dense_rank", v)).alias("dr"), long(F.ntile(4).over(w)).alias("nt"))


@register("ewm_mean", f"with recursive e as (select event_type, ts, event_id, value, row_number() over ({_W}) as k from events), r as (select event_type, ts, event_id, k, value as m, 1.0::double as w from e where k = 1 union all select e.event_type, e.ts, e.event_id, e.k, (r.w * (2.0::double / 3) * r.m + e.value) / (r.w * (2.0::double / 3) + 1), r.w * (2.0::double / 3) + 1 from r join e on e.event_type = r.event_type and e.k = r.k + 1) select event_type, ts, event_id, round(m, 6) as x from r")
def ewm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).ewm("value", com=2, name="x").df.select("event_type", "ts", "event_id", r6("x").alias("x"))


@register("ewm_folded", f"with recursive e as (select user_id, ts, event_id, value, row_number() over (partition by user_id order by ts, event_id) as k from events), r as (select user_id, ts, event_id, k, value as s from e where k = 1 union all select e.user_id, e.ts, e.event_id, e.k, r.s * 0.5::double + e.value from r join e on e.user_id = r.user_id and e.k = r.k + 1) select user_id, ts, event_id, round(s, 6) as x from r")
def ewm_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return ewm.ewm_folded(df, "value", ["ts", "event_id"], ["user_id"], ewm.Decay(alpha=0.5), "sum", "x").select("user_id", "ts", "event_id", r6("x").alias("x"))


_EWM_SQL = (
    f"with recursive e as (select event_type, ts, event_id, value as x, %s as y, row_number() over ({_W}) as k from events), "
    "r as (select event_type, ts, event_id, k, x, y, 1.0::double as w, 1.0::double as w2, x as mx, y as my, 0.0::double as cxy, 0.0::double as cxx, 0.0::double as cyy from e where k = 1 union all "
    "select event_type, ts, event_id, k, x, y, t, w2 * 4.0 / 9 + 1, nx, ny, (t - 1) / t * (cxy + (mx - nx) * (my - ny)) + (x - nx) * (y - ny) / t, (t - 1) / t * (cxx + (mx - nx) ** 2) + (x - nx) ** 2 / t, (t - 1) / t * (cyy + (my - ny) ** 2) + (y - ny) ** 2 / t from "
    "(select *, ((t - 1) * mx + x) / t as nx, ((t - 1) * my + y) / t as ny from (select e.event_type, e.ts, e.event_id, e.k, e.x, e.y, r.w2, r.mx, r.my, r.cxy, r.cxx, r.cyy, r.w * (2.0::double / 3) + 1 as t from r join e on e.event_type = r.event_type and e.k = r.k + 1))) "
    "select event_type, ts, event_id, round(%s, 6) as x from r"
)
_UNBIASED = "case when k > 1 then w * w / (w * w - w2) * cxy end"
_EWM_STATS = {"var": ("x", _UNBIASED), "std": ("x", f"sqrt({_UNBIASED})"), "cov": ("(event_id % 13)::double", _UNBIASED), "corr": ("(event_id % 13)::double", "case when cxx * cyy > 0 then cxy / sqrt(cxx * cyy) end")}

for _stat, (_y, _out) in _EWM_STATS.items():

    def _ewm(spark: SparkSession, sf_dir: str, stat: str = _stat) -> DataFrame:
        f = events(spark, sf_dir)
        f = Frame(f.df.withColumn("y", (F.col("event_id") % 13).cast("double")), "ts", ["ts", "event_id"], ["event_type"])
        return f.ewm("value", stat, other="y" if stat in ("cov", "corr") else None, span=5, name="x").df.select("event_type", "ts", "event_id", r6("x").alias("x"))

    register(f"ewm_{_stat}", _EWM_SQL % (_y.replace("x", "value"), _out))(_ewm)

# aggregates

_GROUP = "l_returnflag, l_linestatus"


@register("groupby_sum", f"select {_GROUP}, round(sum(l_quantity), 4) as l_quantity, round(sum(l_extendedprice), 4) as l_extendedprice from lineitem group by all")
def groupby_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Frame(table(spark, sf_dir, "lineitem")).group_by("l_returnflag", "l_linestatus").agg("sum", columns=["l_quantity", "l_extendedprice"])
    return out.select("l_returnflag", "l_linestatus", F.round("l_quantity", 4).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@register("groupby_multi_key_multi_agg", f"select {_GROUP}, round(sum(l_quantity), 4) as l_quantity_sum, round(avg(l_quantity), 6) as l_quantity_mean, min(l_quantity) as l_quantity_min, max(l_quantity) as l_quantity_max, count(l_quantity) as l_quantity_count, round(stddev(l_quantity), 6) as l_quantity_stddev, round(variance(l_quantity), 6) as l_quantity_variance from lineitem group by all")
def groupby_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Frame(table(spark, sf_dir, "lineitem")).group_by("l_returnflag", "l_linestatus").agg("sum", "mean", "min", "max", "count", "stddev", "variance", columns=["l_quantity"])
    return out.withColumns({"l_quantity_sum": F.round("l_quantity_sum", 4), **{f"l_quantity_{k}": r6(f"l_quantity_{k}") for k in ("mean", "stddev", "variance")}})


@register("groupby_first_last", "select event_type, first(x order by ts, event_id) as x_first, last(x order by ts, event_id) as x_last from (select * from " + _NULLED + ") group by 1")
def groupby_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nulls(spark, sf_dir).group_by("event_type").agg("first", "last", columns=["x"], skip_nulls=False)


@register("groupby_first_last_valid", "select event_type, first(x order by ts, event_id) filter (x is not null) as x_first, last(x order by ts, event_id) filter (x is not null) as x_last from " + _NULLED + " group by 1")
def groupby_first_last_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nulls(spark, sf_dir).group_by("event_type").agg("first", "last", columns=["x"])


@register("groupby_count_distinct", "select o_orderpriority, count(distinct o_custkey) as o_custkey from orders group by 1")
def groupby_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frame(table(spark, sf_dir, "orders")).group_by("o_orderpriority").agg("count_distinct", columns=["o_custkey"])


@register("groupby_median_quantile", "select o_orderpriority, round(median(o_totalprice), 6) as median, round(quantile_cont(o_totalprice, 0.9), 6) as q90 from orders group by 1")
def groupby_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(r6(aggregate.down("median", c)).alias("median"), r6(aggregate.down("quantile", c, q=0.9)).alias("q90"))


@register("groupby_mode", "select l_returnflag, l_quantity, count, rank from (select l_returnflag, l_quantity, count(*) as count, row_number() over (partition by l_returnflag order by count(*) desc, l_quantity) as rank from lineitem group by 1, 2) where rank <= 3")
def groupby_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Frame(table(spark, sf_dir, "lineitem")).group_by("l_returnflag").mode("l_quantity", 3)
    return out.withColumn("rank", F.col("rank").cast("long"))


@register("groupby_bool", "select o_orderstatus, bool_and(o_totalprice > 1000) as all_, bool_or(o_totalprice > 400000) as any_ from orders group by 1")
def groupby_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(aggregate.down("all", c > 1000).alias("all_"), aggregate.down("any", c > 400000).alias("any_"))


@register("groupby_min_count", "select l_suppkey, case when count(*) >= 60 then round(sum(l_quantity), 4) end as l_quantity from lineitem group by 1")
def groupby_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Frame(table(spark, sf_dir, "lineitem")).group_by("l_suppkey").agg("sum", columns=["l_quantity"], min_count=60)
    return out.withColumn("l_quantity", F.round("l_quantity", 4))


@register("groupby_product", "select o_orderstatus, round(product(1 + o_totalprice / 1e10), 8) as p from orders group by 1")
def groupby_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(aggregate.down("product", 1 + F.col("o_totalprice") / 1e10), 8).alias("p"))


@register("groupby_rollup", "select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as l_quantity_sum from lineitem group by rollup (l_returnflag, l_linestatus)")
def groupby_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frame(table(spark, sf_dir, "lineitem")).group_by("l_returnflag", "l_linestatus").rollup("sum", columns=["l_quantity"]).withColumn("l_quantity_sum", F.round("l_quantity_sum", 4))


@register("groupby_apply", "select event_type, round(max(value) - min(value), 6) as spread, count(*) as n from events group by 1")
def groupby_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_type": [pdf.event_type.iloc[0]], "spread": [round(pdf.value.max() - pdf.value.min(), 6)], "n": [len(pdf)]})

    f = events(spark, sf_dir)
    return Frame(f.df, "ts", ["ts", "event_id"]).group_by("event_type").apply(spread, "event_type string, spread double, n long")


@register("frame_agg_down", "select round(sum(l_quantity), 4) as s, round(avg(l_discount), 6) as m, min(l_tax) as lo, max(l_tax) as hi, round(stddev_pop(l_quantity), 6) as sd, round(var_samp(l_quantity), 6) as v1, count(*) as n, count(distinct l_suppkey) as d, round(corr(l_quantity, l_extendedprice), 6) as c from lineitem")
def frame_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, q = aggregate.down, F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").agg(
        F.round(a("sum", q), 4).alias("s"), r6(a("mean", F.col("l_discount"), exact=True)).alias("m"), a("min", F.col("l_tax")).alias("lo"), a("max", F.col("l_tax")).alias("hi"), r6(a("stddev", q)).alias("sd"), r6(a("variance", q, ddof=1)).alias("v1"),
        a("count_all", q).alias("n"), a("count_distinct", F.col("l_suppkey")).alias("d"), r6(a("corr", q, other=F.col("l_extendedprice"))).alias("c"),
    )


@register("frame_agg_across", f"select {LINE_SQL}, round(l_quantity + l_discount + l_tax, 6) as s, round((l_quantity + l_discount + l_tax) / 3, 6) as m, least(l_quantity, l_discount, l_tax) as lo, greatest(l_quantity, l_discount, l_tax) as hi, list_sort([l_quantity, l_discount, l_tax])[2] as med from lineitem")
def frame_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]
    a = lambda n: aggregate.across(n, cols)
    return table(spark, sf_dir, "lineitem").select(*LINE, r6(a("sum")).alias("s"), r6(a("mean")).alias("m"), a("min").alias("lo"), a("max").alias("hi"), a("median").alias("med"))


# order, selection, duplicates


@register("sort_values_all", "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc nulls last, o_orderkey) as place from orders")
def sort_values_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")], "place")
    return placed.withColumn("place", F.col("place") + 1)


@register("n_largest", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25")
def n_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.n_largest(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 25, ["c_custkey"])


@register("n_smallest", "select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 25")
def n_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.n_smallest(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 25, ["c_custkey"])


@register("head_tail", "(select 'head' as part, event_id from events order by ts, event_id limit 10) union all (select 'tail' as part, event_id from events order by ts desc, event_id desc limit 10)")
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "events").select("ts", "event_id"), "ts", ["ts", "event_id"])
    return f.head().df.select(F.lit("head").alias("part"), "event_id").unionAll(f.tail().df.select(F.lit("tail").alias("part"), "event_id"))


@register("iloc_slice", "select event_id, ts from (select *, row_number() over (order by ts, event_id) - 1 as k from events) where k >= 100 and k < 700 and (k - 100) % 7 = 0")
def iloc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "events").select("ts", "event_id"), "ts", ["ts", "event_id"])
    return f.iloc(slice(100, 700, 7)).df.select("event_id", "ts")


@register("loc_slice", "select event_id, ts, value from events where ts between timestamp '2024-01-05' and timestamp '2024-01-09 12:00:00'")
def loc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "events").select("ts", "event_id", "value"), "ts", ["ts", "event_id"])
    return f.loc(slice(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 12))).df.select("event_id", "ts", "value")


for _keep, _sql in (("first", "row_number() over (partition by user_id, event_type order by ts, event_id) = 1"), ("last", "row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"), ("false", "count(*) over (partition by user_id, event_type) = 1")):

    def _dedup(spark: SparkSession, sf_dir: str, keep: str = _keep) -> DataFrame:
        df = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
        return select.drop_duplicates(df, ["user_id", "event_type"], ["ts", "event_id"], False if keep == "false" else keep)

    register(f"drop_duplicates_{_keep}", f"select user_id, event_type, ts, event_id from events qualify {_sql}")(_dedup)


@register("value_counts", "select p_brand, count(*) as count from part group by 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.value_counts(table(spark, sf_dir, "part"), "p_brand")


@register("unique", "select distinct event_type from events")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.unique(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"])


@register("dictionary_encode", "select event_id, event_type, code from events join (select event_type, row_number() over (order by min((ts, event_id))) - 1 as code from events group by 1) using (event_type)")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.dictionary_encode(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "code")


@register("where", "select event_id, case when value > 50 then value else 0.0 end as value from events")
def where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", L.where(F.col("value") > 50, F.col("value"), F.lit(0.0)).alias("value"))


@register("isin", "select event_id, event_type in ('click', 'view') as hit, case event_type when 'view' then 0 when 'error' then 1 end as at from events")
def isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", L.isin(c, ["click", "view"]).alias("hit"), L.index_in(c, ["view", "error"]).alias("at"))


@register("drop_null_thresh", "select event_id, a, b from (select event_id, case when event_id % 2 = 0 then value end as a, case when event_id % 3 = 0 then value end as b from events) where (a is not null)::int + (b is not null)::int >= 1")
def drop_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("b"))
    return select.drop_null(df, thresh=1, subset=["a", "b"])


@register("fill_null", "select event_id, coalesce(case when event_id % 2 = 0 then value end, -1.0) as value from events")
def fill_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.fill_null(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value")), -1.0, ["value"])


@register("take_positions", "select event_id, count(*) as n from (select event_id, row_number() over (order by ts, event_id) - 1 as k, count(*) over () as total from events) join (values (3), (0), (3), (-1)) p(i) on k = case when i < 0 then total + i else i end group by 1")
def take_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = select.take(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"], [3, 0, 3, -1])
    return got.groupBy("event_id").agg(F.count("*").alias("n"))


@register("diff_frames", "select c_custkey, 'c_acctbal' as \"column\" from customer where c_custkey % 4 = 0 and c_acctbal <> 0")
def diff_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    b = a.withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal")))
    return combine.diff_frames(a, b, ["c_custkey"]).select("c_custkey", "column")


@register("groupby_cube", "select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as l_quantity_sum from lineitem group by cube (l_returnflag, l_linestatus)")
def groupby_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frame(table(spark, sf_dir, "lineitem")).group_by("l_returnflag", "l_linestatus").cube("sum", columns=["l_quantity"]).withColumn("l_quantity_sum", F.round("l_quantity_sum", 4))


@register("groupby_index_value", "select l_returnflag, min(k) as first_at from (select l_returnflag, l_quantity, row_number() over (order by " + LINE_SQL + ") - 1 as k from lineitem) where l_quantity = 7 group by 1")
def groupby_index_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_position(table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag", "l_quantity"), LINE, "k")
    return rows.groupBy("l_returnflag").agg(aggregate.down("index", F.col("l_quantity"), value=7.0, pos=F.col("k")).alias("first_at")).where("first_at is not null")


@register("searchsorted", "select count(*) filter (value < 50) as l, count(*) filter (value <= 50) as r from events")
def searchsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return select.searchsorted(df, "value", 50).select(F.col("position").alias("l")).crossJoin(select.searchsorted(df, "value", 50, "right").select(F.col("position").alias("r")))


@register("monotonic", "select bool_and(coalesce(event_id >= p, true)) as increasing, bool_and(coalesce(event_id <= p, true)) as decreasing from (select event_id, lag(event_id) over (order by ts, event_id) as p from events)")
def monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.monotonic(table(spark, sf_dir, "events"), "event_id", ["ts", "event_id"])


# alignment and concatenation


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return df, df.withColumn("o_orderkey", F.col("o_orderkey") + 1000)


_HALVES = "with a as (select o_orderkey, o_totalprice from orders), b as (select o_orderkey + 1000 as o_orderkey, o_totalprice from orders) "


@register("aligned_add", _HALVES + "select o_orderkey, round(a.o_totalprice + b.o_totalprice, 6) as o_totalprice from a full join b using (o_orderkey)")
def aligned_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    out = Frame(a, "o_orderkey") + Frame(b, "o_orderkey")
    return out.df.select("o_orderkey", r6("o_totalprice").alias("o_totalprice"))


@register("concat_rows", _HALVES + "select o_orderkey, o_totalprice from a union all select o_orderkey, o_totalprice from b")
def concat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.concat_rows(list(_halves(spark, sf_dir)))


for _join, _kind in (("inner", "join"), ("outer", "full join")):

    def _concat(spark: SparkSession, sf_dir: str, join: str = _join) -> DataFrame:
        a, b = _halves(spark, sf_dir)
        return combine.concat_columns([a, b.withColumnRenamed("o_totalprice", "other")], ["o_orderkey"], join)

    register(f"concat_columns_{_join}", _HALVES + f"select o_orderkey, a.o_totalprice, b.o_totalprice as other from a {_kind} b using (o_orderkey)")(_concat)


@register("reindex_fill_all", "with k as (select o_orderkey from orders union all select (select max(o_orderkey) from orders) + i + 1 from range(0, 500) t(i)) select o_orderkey, coalesce(o_totalprice, -1.0) as o_totalprice from k left join orders using (o_orderkey)")
def reindex_fill_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    beyond = spark.range(500).crossJoin(F.broadcast(df.agg(F.max("o_orderkey").alias("top")))).select((F.col("top") + F.col("id") + 1).alias("o_orderkey"))
    return combine.reindex(df, df.select("o_orderkey").unionAll(beyond), "o_orderkey", -1.0)


@register("update_labels", "select c_custkey, case when c_custkey % 5 = 0 then 0.0 else c_acctbal end as c_acctbal from customer")
def update_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return combine.update(df, df.where("c_custkey % 5 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")), ["c_custkey"])


for _name, _f, _sql in (
    ("union", combine.label_union, "select o_orderkey from a union select o_orderkey from b"),
    ("intersection", combine.label_intersection, "select o_orderkey from a where o_orderkey in (select o_orderkey from b)"),
    ("difference", combine.label_difference, "select o_orderkey from a where o_orderkey not in (select o_orderkey from b)"),
    ("symdiff", combine.label_symmetric_difference, "(select o_orderkey from a except select o_orderkey from b) union all (select o_orderkey from b except select o_orderkey from a)"),
):

    def _labels(spark: SparkSession, sf_dir: str, f: Callable = _f) -> DataFrame:
        return f(*_halves(spark, sf_dir), "o_orderkey")

    register(f"index_{_name}", _HALVES + _sql)(_labels)


@register("merge_join", "select c_custkey, n_name, r_name, count(o_orderkey) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join orders on o_custkey = c_custkey group by all")
def merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    out = combine.merge(combine.merge(c, t("nation").withColumnRenamed("n_regionkey", "r_regionkey"), ["n_nationkey"]), t("region"), ["r_regionkey"])
    per = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return combine.merge(out, per, ["c_custkey"], "left").select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n"))


@register("asof_join", "select e.event_id, p.value as last_purchase from (select * from events where event_type = 'click') e asof left join (select user_id, ts, max_by(value, event_id) as value from events where event_type = 'purchase' group by all) p on e.user_id = p.user_id and e.ts >= p.ts")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    buys = df.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("last_purchase"))
    clicks = df.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return combine.asof_join(clicks, buys, "ts", ["user_id"], ["last_purchase"], ["event_id"]).select("event_id", "last_purchase")


# element-wise


@register("math_exp_log", "select event_id, round(exp(value / 100), 6) as e, case when value > 0 then round(ln(value), 6) when value = 0 then '-inf'::double else 'nan'::double end as ln, round(sqrt(abs(value)), 6) as sq, round(log10(abs(value) + 1), 6) as l10, round(log2(abs(value) + 1), 6) as l2, round(pow(value / 100, 3), 6) as p from events")
def math_exp_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", r6(F.exp(v / 100)).alias("e"), F.coalesce(r6(M.ln(v)), F.lit(M.NAN)).alias("ln"), r6(F.sqrt(F.abs(v))).alias("sq"), r6(M.log10(F.abs(v) + 1)).alias("l10"), r6(M.log2(F.abs(v) + 1)).alias("l2"), r6(M.power(v / 100, 3.0)).alias("p"))


_TRIG = ("sin", "cos", "tan", "atan", "sinh", "cosh", "tanh", "asinh")


@register("math_trig", "select event_id, " + ", ".join(f"round({f}(value / 100), 6) as {f}" for f in _TRIG) + ", round(atan2(value, 2.0), 6) as atan2 from events")
def math_trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", *[r6(getattr(F, f)(v / 100)).alias(f) for f in _TRIG], r6(F.atan2(v, F.lit(2.0))).alias("atan2"))


@register("math_round", "select event_id, floor(x)::double as down, ceil(x)::double as up, trunc(x)::double as toward, case when x < 0 then floor(x) else ceil(x) end::double as away, round_even(x, 0)::double as even, round(x)::double as half_away, floor(x + 0.5)::double as half_up from (select event_id, (event_id % 41 - 20) / 4.0::double as x from events)")
def math_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("event_id") % 41 - 20) / F.lit(4.0)
    modes = {"down": "down", "up": "up", "toward": "towards_zero", "away": "towards_infinity", "even": "half_to_even", "half_away": "half_towards_infinity", "half_up": "half_up"}
    return table(spark, sf_dir, "events").select("event_id", *[M.round_mode(x, 0, m).alias(k) for k, m in modes.items()])


@register("math_division", "select event_id, case when event_id % 5 = 0 then case when value > 0 then 'inf'::double when value < 0 then '-inf'::double else 'nan'::double end else round(value / (event_id % 5), 6) end as f, (event_id - 500) // 7 as i from events")
def math_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, by = F.col("value"), F.col("event_id") % 5
    x = F.when((by == 0) & v.isNull(), 0.0).when((by == 0) & F.isnan(v), M.INF).otherwise(v)  # over zero, SQL takes a null for 0 and NaN for the largest number
    return table(spark, sf_dir, "events").select("event_id", r6(M.divide(x, by)).alias("f"), M.divide_int(F.col("event_id") - 500, F.lit(7)).alias("i"))


@register("bitwise", "select event_id, event_id & 12 as a, event_id | 3 as o, xor(event_id, 5) as x, ~event_id as n, event_id << 3 as l, event_id >> 2 as r from events")
def bitwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("event_id"), lambda n: F.lit(n).cast("long")
    return table(spark, sf_dir, "events").select("event_id", M.bit_and(c, k(12)).alias("a"), M.bit_or(c, k(3)).alias("o"), M.bit_xor(c, k(5)).alias("x"), M.bit_not(c).alias("n"), M.shift_left(c, 3).alias("l"), M.shift_right(c, 2).alias("r"))


@register("logic_non_kleene", "select event_id, case when a is null or b is null then null else a and b end as and_, case when a is null or b is null then null else a or b end as or_, a <> b as xor_, a and b as kleene from (select event_id, case when event_id % 3 = 0 then null else event_id % 2 = 0 end as a, case when event_id % 5 = 0 then null else event_id % 7 < 3 end as b from events)")
def logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    a, b = F.when(e % 3 != 0, e % 2 == 0), F.when(e % 5 != 0, e % 7 < 3)
    return table(spark, sf_dir, "events").select("event_id", L.and_(a, b).alias("and_"), L.or_(a, b).alias("or_"), L.xor(a, b).alias("xor_"), L.and_kleene(a, b).alias("kleene"))


# strings


@register("string_predicates", "select doc_id, regexp_full_match(lang, '[a-z]+') as lower_, regexp_matches(source, '^[A-Za-z0-9]+$') as alnum, regexp_full_match(source, '[0-9]+') as digits, strlen(text) = length(text) as is_ascii, starts_with(text, 'Th') as th, contains(text, 'tion') as tion from documents")
def string_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = F.col("text"), F.col("source")
    return table(spark, sf_dir, "documents").select("doc_id", S.ascii_is_lower(F.col("lang")).alias("lower_"), S.matches_class(s, "ascii_is_alnum").alias("alnum"), S.matches_class(s, "ascii_is_decimal").alias("digits"), S.is_ascii(t).alias("is_ascii"), S.starts_with(t, "Th").alias("th"), S.match_substring(t, "tion").alias("tion"))


@register("string_case", "select p_partkey, upper(p_name) as u, lower(p_brand) as l, reverse(p_type) as r, upper(left(p_name, 1)) || lower(substr(p_name, 2)) as c, length(p_name) as n from part")
def string_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.utf8_upper(F.col("p_name")).alias("u"), S.ascii_lower(F.col("p_brand")).alias("l"), S.reverse(F.col("p_type")).alias("r"), S.utf8_capitalize(F.col("p_name")).alias("c"), S.utf8_length(F.col("p_name")).cast("long").alias("n"))


@register("string_pad_trim", "select p_partkey, case when length(p_brand) >= 12 then p_brand else lpad(p_brand, 12, '*') end as lp, case when length(p_brand) >= 4 then p_brand else rpad(p_brand, 4, '*') end as rp, trim(p_brand, 'B1') as t, repeat('-', (15 - length(p_brand)) // 2) || p_brand || repeat('-', (15 - length(p_brand)) - (15 - length(p_brand)) // 2) as c from part")
def string_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", S.lpad(c, 12, "*").alias("lp"), S.rpad(c, 4, "*").alias("rp"), S.trim(c, "B1").alias("t"), S.center(c, 15, "-").alias("c"))


@register("string_search", "select doc_id, (length(text) - length(replace(text, 'an', ''))) // 2 as n, case when instr(text, 'tion') = 0 then -1 else strlen(left(text, instr(text, 'tion') - 1)) end as at, text like '%the%' as the, left(text, 5) as s from documents")
def string_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.count_substring(t, "an").cast("long").alias("n"), S.find_substring(t, "tion").cast("long").alias("at"), S.match_like(t, "%the%").alias("the"), S.slice_codeunits(t, 0, 5).alias("s"))


@register("string_replace", "select doc_id, length(replace(text, 'e', '3')) as n, md5(replace(text, 'e', '3')) as r from documents")
def string_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.replace_substring(F.col("text"), "e", "3")
    return table(spark, sf_dir, "documents").select("doc_id", S.utf8_length(r).cast("long").alias("n"), F.md5(r.cast("binary")).alias("r"))


@register("string_split", "select p_partkey, array_to_string(string_split(p_type, ' '), '/') as j, len(string_split(p_type, ' ')) as n, string_split(p_type, ' ')[1] as f from part")
def string_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.split_pattern(F.col("p_type"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parts, "/").alias("j"), F.size(parts).cast("long").alias("n"), parts[0].alias("f"))


@register("string_extract", r"select page_id, nullif(regexp_extract(url, '^(\w+)://([^/]+)', 1), '') as scheme, nullif(regexp_extract(url, '^(\w+)://([^/]+)', 2), '') as host from pages")
def string_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.extract_regex(F.col("url"), r"^(\w+)://([^/]+)", ["scheme", "host"])
    return table(spark, sf_dir, "pages").select("page_id", got["scheme"].alias("scheme"), got["host"].alias("host"))


# time


@register("temporal_parts", "select event_id, year(ts) as y, quarter(ts) as q, month(ts) as mo, day(ts) as d, hour(ts) as h, minute(ts) as mi, second(ts) as s, isodow(ts) - 1 as dow, dayofyear(ts) as doy, weekofyear(ts) as w, isoyear(ts) as iy, (epoch_us(ts) % 1000000) // 1000 as ms from events")
def temporal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("ts")
    parts = {"y": T.year, "q": T.quarter, "mo": T.month, "d": T.day, "h": T.hour, "mi": T.minute, "s": T.second, "dow": T.day_of_week, "doy": T.day_of_year, "w": T.iso_week, "iy": T.iso_year, "ms": T.millisecond}
    return table(spark, sf_dir, "events").select("event_id", *[f(c).cast("long").alias(k) for k, f in parts.items()])


@register("temporal_floor_ceil", "select event_id, time_bucket(interval 15 minute, ts, timestamp '1970-01-01') as f, date_trunc('month', ts)::timestamp as m, date_trunc('week', ts)::timestamp as w, case when date_trunc('hour', ts) = ts then ts else date_trunc('hour', ts) + interval 1 hour end as c, case when ts - date_trunc('day', ts) >= interval 12 hour then date_trunc('day', ts) + interval 1 day else date_trunc('day', ts) end::timestamp as r from events")
def temporal_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", T.floor(c, "minute", 15).alias("f"), T.floor(c, "month").alias("m"), T.floor(c, "week").alias("w"), T.ceil(c, "hour").alias("c"), T.round_to(c, "day").alias("r"))


@register("temporal_between", "select o_orderkey, " + ", ".join(f"date_diff('{u}', o_orderdate, timestamp '1998-08-02 13:00:00') as {u}s" for u in ("year", "quarter", "month", "day", "hour", "minute")) + ", date_diff('day', date_trunc('week', o_orderdate), date_trunc('week', timestamp '1998-08-02 13:00:00')) // 7 as weeks from orders")
def temporal_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit(dt.datetime(1998, 8, 2, 13)).cast(NTZ)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[T.between(F.col("o_orderdate"), end, u).alias(f"{u}s") for u in ("year", "quarter", "month", "week", "day", "hour", "minute")])


@register("strftime", "select event_id, strftime(ts, '%Y/%m/%d %H-%M-%S') as s from events")
def strftime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.strftime(F.col("ts"), "%Y/%m/%d %H-%M-%S").alias("s"))


@register("tz_convert", "select event_id, timezone('America/New_York', timezone('UTC', ts)) as ny, timezone('Asia/Tokyo', timezone('UTC', ts)) as tokyo from events")
def tz_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", T.local_timestamp(c, "America/New_York").alias("ny"), T.local_timestamp(c, "Asia/Tokyo").alias("tokyo"))


@register("tz_localize", "select event_id, timezone('UTC', timezone('America/New_York', ts)) as utc from events")
def tz_localize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.tz_localize(F.col("ts"), "America/New_York").cast(NTZ).alias("utc"))


@register("month_end_offset", "select o_orderkey, case when last_day(o_orderdate) = o_orderdate::date then last_day(o_orderdate + interval 1 month) else last_day(o_orderdate) end::timestamp as me, (date_trunc('month', o_orderdate) + interval 1 month)::timestamp as ms, (date_trunc('quarter', o_orderdate) + interval 3 month)::timestamp as qs, (date_trunc('year', o_orderdate) + interval 1 year)::timestamp as ys from orders")
def month_end_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", O.month_end().column(c).alias("me"), O.month_start().column(c).alias("ms"), O.quarter_start().column(c).alias("qs"), O.year_start().column(c).alias("ys"))


@register("bday_offset", "select o_orderkey, (o_orderdate + to_days(case isodow(o_orderdate) when 5 then 3 when 6 then 2 else 1 end)) as next_bday, (o_orderdate + to_days(7 + case isodow(o_orderdate) when 6 then -1 when 7 then -2 else 0 end)) as five, o_orderdate + to_days(((7 - isodow(o_orderdate) + 1)::int - 1) % 7 + case when isodow(o_orderdate) = 7 then 7 else 0 end) as sunday from orders")
def bday_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", O.bday().column(c).alias("next_bday"), O.bday(5).column(c).alias("five"), O.Week(1, 6).column(c).alias("sunday"))


@register("trading_schedule")
def trading_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return get_calendar("NYSE").schedule(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)).withColumns({k: F.col(k).cast(NTZ) for k in ("pre", "open", "close", "post")})


@register("open_at_time")
def events_in_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedule = get_calendar("NYSE").schedule(spark, dt.date(2023, 12, 25), dt.date(2024, 2, 10), ("open", "close"))
    return open_at_time(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", schedule).select("event_id", "is_open")


# SQL and I/O


@register("sql_self_cte_window", "with r as (select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id) as rn from events) select event_type, event_id, value, rn from r where rn <= 3")
def sql_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM self) SELECT event_type, event_id, value, CAST(rn AS bigint) AS rn FROM r WHERE rn <= 3"
    return query(table(spark, sf_dir, "events"), text)


@register("sql_self_decimal", "select event_type, sum(value::decimal(18, 4))::double as total, count(*) as n from events group by 1")
def sql_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "events"), "SELECT event_type, sum(CAST(value AS decimal(18, 4))) AS total, count(*) AS n FROM self GROUP BY event_type")


@register("sql_self_case", "select event_id, case when value > 75 then 'high' when value in (0, 1, 2) then 'odd' else 'low' end as band, abs(floor(value)) as f from events where event_type in ('click', 'view')")
def sql_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "events"), "SELECT event_id, CASE WHEN value > 75 THEN 'high' WHEN value IN (0, 1, 2) THEN 'odd' ELSE 'low' END AS band, CAST(abs(floor(value)) AS double) AS f FROM self WHERE event_type IN ('click', 'view')")


# windows over a whole frame, without keys


def plain_events(spark: SparkSession, sf_dir: str) -> Frame:
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return Frame(df, "event_id")


_PLAIN = "with e as (select event_id, case when event_id % 7 <> 0 then value end as v from events) "


@register("ffill_unkeyed", _PLAIN + "select event_id, last_value(v ignore nulls) over (order by event_id rows between unbounded preceding and current row) as v from e")
def ffill_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_events(spark, sf_dir).ffill().df


@register("bfill_unkeyed", _PLAIN + "select event_id, first_value(v ignore nulls) over (order by event_id rows between current row and unbounded following) as v from e")
def bfill_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_events(spark, sf_dir).bfill().df


for _name, _sql in (("sum", "sum(v)"), ("mean", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("count_valid", "count(v)"), ("variance", "var_samp(v)"), ("stddev", "stddev_samp(v)")):

    def _expanding(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        return plain_events(spark, sf_dir).expanding(name, min_periods=3).df.select("event_id", F.round(F.col("v").cast("double"), 5 if "v" in name else 9).alias("v"))

    register(f"expanding_{_name}_unkeyed", _PLAIN + f"select event_id, case when count(v) over w >= 3 then round(({_sql} over w)::double, {5 if 'v' in _name else 9}) end as v from e window w as (order by event_id rows between unbounded preceding and current row)")(_expanding)


@register("cumulative_mean_unkeyed", _PLAIN + "select event_id, case when v is not null then round((sum(v) over w + 10) / (count(v) over w + 1), 6) end as v from e window w as (order by event_id rows between unbounded preceding and current row)")
def cumulative_mean_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_events(spark, sf_dir).cumulative("mean", start=10.0).df.select("event_id", r6("v").alias("v"))


@register("cumulative_prod_unkeyed", "select event_id, round(product(1 + (event_id % 5 - 2) / 1000.0) over (order by event_id rows between unbounded preceding and current row), 9) as v from events")
def cumulative_prod_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", (1 + (F.col("event_id") % 5 - 2) / 1000.0).alias("v"))
    return Frame(df, "event_id").cumulative("prod").df.select("event_id", F.round("v", 9).alias("v"))


@register("asof_join_unkeyed", "select e.event_id, (select max(o_orderdate) from orders where o_orderdate <= e.ts) as last_order from events e")
def asof_join_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "events").select("event_id", "ts")
    right = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast(left.schema["ts"].dataType).alias("ts"), F.col("o_orderdate").alias("last_order"))
    return combine.asof_join(left, right, "ts", [], ["last_order"]).select("event_id", "last_order")


@register("rolling_product", "select event_id, case when count(*) over w >= 5 then round(product(1 + value / 100) over w, 6) end as v from events window w as (partition by event_type order by ts, event_id rows between 4 preceding and current row)")
def rolling_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events(spark, sf_dir)
    return f.assign(value=1 + F.col("value") / 100).rolling("product", 5, ["value"]).df.select("event_id", r6("value").alias("v"))


# labels, positions and pairs with nulls and repeats


@register("idx_extremes", "select l_returnflag, min(k) filter (l_shipdate = hi) as last_mode_at, min(k) filter (l_shipdate = lo) as first_mode_at from (select l_returnflag, l_shipdate, max(l_shipdate) over (partition by l_returnflag) as hi, min(l_shipdate) over (partition by l_returnflag) as lo, row_number() over (order by " + LINE_SQL + ") - 1 as k from lineitem) group by 1")
def idx_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_position(table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag"), LINE, "k")
    at = lambda name: aggregate.down(name, F.col("l_shipdate"), pos=F.col("k"))
    return rows.groupBy("l_returnflag").agg(at("idx_max").alias("last_mode_at"), at("idx_min").alias("first_mode_at"))


@register("cov_ddof", "select l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 3) as c1, round(covar_pop(l_quantity, l_extendedprice) * count(*) / (count(*) - 2), 3) as c2 from lineitem group by 1")
def cov_ddof(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    cols = [F.round(aggregate.down("cov", q, other=p, ddof=d, min_periods=5), 3).alias(f"c{d}") for d in (1, 2)]
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*cols)


_LABELS = "with a as (select case when c_custkey % 10 = 0 then null else c_custkey end as k from customer), b as (select case when s_suppkey % 3 = 0 then null else s_suppkey end as k from supplier) "


for _name, _op, _sql in (
    ("intersection", combine.label_intersection, "select k from a where exists (select 1 from b where b.k is not distinct from a.k)"),
    ("difference", combine.label_difference, "select k from a where not exists (select 1 from b where b.k is not distinct from a.k)"),
    ("symmetric_difference", combine.label_symmetric_difference, "select k from a where not exists (select 1 from b where b.k is not distinct from a.k) union all select k from b where not exists (select 1 from a where a.k is not distinct from b.k)"),
):

    def _labels(spark: SparkSession, sf_dir: str, op: Callable = _op) -> DataFrame:
        a = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k"))
        b = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")).alias("k"))
        return op(a, b, "k")

    register(f"index_{_name}_nulls", _LABELS + _sql)(_labels)


@register("update_repeated_labels", "select o_orderkey, coalesce(p, o_totalprice) as o_totalprice from orders left join (select l_orderkey, arg_max(l_extendedprice, l_linenumber * 100000000.0 + l_extendedprice) as p from lineitem group by 1) on o_orderkey = l_orderkey")
def update_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"), "l_linenumber")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    last = changes.select("o_orderkey", "o_totalprice", "l_linenumber")
    return combine.update(df.withColumn("l_linenumber", F.lit(0)), last, ["o_orderkey"], ["l_linenumber", "o_totalprice"]).select("o_orderkey", "o_totalprice")


# element-wise, shape and generators


@register("comparisons", "select o_orderkey, " + ", ".join(f"o_totalprice {op} 150000 as {n}" for n, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))) + " from orders")
def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    f = Frame(out, "o_orderkey")
    return combine.concat_columns([f.compare(150000, how).df.withColumnRenamed("o_totalprice", how) for how in ("eq", "ne", "lt", "le", "gt", "ge")], ["o_orderkey"], "inner")


_WITH_NULLS = "with e as (select event_id, case when event_id % 3 = 0 then null when event_id % 5 = 0 then 'nan'::double when event_id % 7 = 0 then 'inf'::double else value end as v, case when event_id % 2 = 0 then null else event_id % 4 = 1 end as b from events) "


@register("null_predicates", _WITH_NULLS + "select event_id, v is null as isnull, v is not null as valid, (v is null) or isnan(v) as nan_is_null, case when v is not null then isfinite(v) end as finite, case when v is not null then isinf(v) end as inf, coalesce(b, true) as t, not b as inv from e")
def null_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    v = F.when(e % 3 == 0, None).when(e % 5 == 0, float("nan")).when(e % 7 == 0, float("inf")).otherwise(F.col("value"))
    df = table(spark, sf_dir, "events").select("event_id", v.alias("v"), F.when(e % 2 != 0, e % 4 == 1).alias("b"))
    v, b = F.col("v"), F.col("b")
    return df.select("event_id", L.is_null(v).alias("isnull"), L.is_valid(v).alias("valid"), L.is_null(v, True).alias("nan_is_null"), L.is_finite(v).alias("finite"), L.is_inf(v).alias("inf"), F.when(b.isNull(), True).otherwise(b).alias("t"), L.invert(b).alias("inv"))


@register("kleene_logic", "select event_id, a and b as and_, a or b as or_, a and not b as and_not from (select event_id, case when event_id % 3 = 0 then null else event_id % 2 = 0 end as a, case when event_id % 5 = 0 then null else event_id % 7 < 3 end as b from events)")
def kleene_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    a, b = F.when(e % 3 != 0, e % 2 == 0), F.when(e % 5 != 0, e % 7 < 3)
    return table(spark, sf_dir, "events").select("event_id", L.and_kleene(a, b).alias("and_"), L.or_kleene(a, b).alias("or_"), L.and_not_kleene(a, b).alias("and_not"))


@register("reverse_arithmetic", "select c_custkey, round(1000 - c_acctbal, 6) as sub, round(3 * c_acctbal, 6) as mul, round(-c_acctbal, 6) as neg, round(pow(c_acctbal, 2), 4) as pow from customer")
def reverse_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal")), "c_custkey")
    out = (1000 - f).df.select("c_custkey", r6("c_acctbal").alias("sub"))
    for name, g in (("mul", 3 * f), ("neg", -f), ("pow", f**2)):
        out = out.join(g.df.select("c_custkey", F.round("c_acctbal", 4 if name == "pow" else 6).alias(name)), "c_custkey")
    return out


@register("frame_shape", "select p_partkey as k, p_size::double as x_p_size, p_name as x_name from part")
def frame_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "part"), "p_partkey")[["p_name", "p_size", "p_type"]].drop("p_type").rename({"p_name": "name"}).cast({"p_size": "double"})
    return f.add_prefix("x_").rename({"p_partkey": "k"}).sort_columns().df


@register("frame_assign", "select s_suppkey, s_name, s_acctbal * 2 as twice, 7 as seven from supplier")
def frame_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey")
    return f.assign(twice=F.col("s_acctbal") * 2, seven=F.lit(7)).drop("s_acctbal").df


@register("frame_flatten", "select n_name as value from nation union all select n_nationkey::varchar || '!' from nation")
def frame_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.col("n_nationkey").cast("string"), F.lit("!")).alias("mark"))
    return Frame(df, "n_nationkey").flatten()


# functions of users, places of groups, exact quantiles


@register("apply_scalar", "select c_mktsegment, max(c_acctbal) - min(c_acctbal) as span from customer group by 1")
def apply_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey")
    return f.group_by("c_mktsegment").apply(lambda p: float(p["c_acctbal"].max() - p["c_acctbal"].min()), "span double", "scalar")


@register("apply_row", "select o_orderpriority, count(*) as n, max_by(o_totalprice, o_orderkey) as last_price from orders group by 1")
def apply_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey")
    return f.group_by("o_orderpriority").apply(lambda p: {"n": len(p), "last_price": p["o_totalprice"].iloc[-1]}, "n bigint, last_price double", "row")


@register("apply_series", "select event_type, row_number() over w - 1 as pos, round(sum(value) over w, 4) as total from events window w as (partition by event_type order by event_id)")
def apply_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")
    return f.group_by("event_type").apply(lambda p: p["value"].cumsum(), "total double", "series").withColumn("total", F.round("total", 4))


@register("rolling_apply_frame", "select event_id, max(value) over w - min(value) over w as span, count(*) over w as n from events window w as (order by event_id rows between 3 preceding and current row)")
def rolling_apply_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")

    def make(p):
        v = p["value"].to_numpy("float64")
        return {"span": np.fmax.reduce(v) - np.fmin.reduce(v), "n": len(v)}

    return f.rolling_apply_frame(make, ["value"], 4, "span double, n bigint", min_periods=1).df.select("event_id", "applied.span", "applied.n")


@register("groupby_groups", "select c_mktsegment, dense_rank() over (order by first) - 1 as \"group\", pos from (select c_mktsegment, pos, min(pos) over (partition by c_mktsegment) as first from (select c_mktsegment, row_number() over (order by c_custkey) - 1 as pos from customer))")
def groupby_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frame(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").group_by("c_mktsegment").groups()


@register("groupby_expression", "select year(o_orderdate) as y, round(sum(o_totalprice), 2) as total from orders group by 1")
def groupby_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderkey")
    out = f.group_by(F.year("o_orderdate").cast("long")).agg("sum", columns=["o_totalprice"])
    return out.select(F.col("__groupby_key_0__").alias("y"), F.round("o_totalprice", 2).alias("total"))


_PLACED = "with p as (select l_returnflag, l_extendedprice::double as v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as k, (count(*) over (partition by l_returnflag) - 1) * 0.37::double as h from lineitem where l_extendedprice is not null) "
_BESIDE = {"lower": "max(case when k = floor(h) then v end)", "higher": "max(case when k = ceil(h) then v end)", "nearest": "max(case when k = round_even(h, 0) then v end)", "midpoint": "(max(case when k = floor(h) then v end) + max(case when k = ceil(h) then v end)) / 2"}
for _name, _sql in _BESIDE.items():

    def _quantile(spark: SparkSession, sf_dir: str, how: str = _name) -> DataFrame:
        df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
        return aggregate.quantiles(df, "l_extendedprice", 0.37, ["l_returnflag"], how).select("l_returnflag", F.round("l_extendedprice", 6).alias("q"))

    register(f"groupby_quantile_{_name}", _PLACED + f"select l_returnflag, round({_sql}, 6) as q from p group by 1")(_quantile)


@register("ewm_unkeyed", "with recursive e as (select event_id, case when event_id % 7 <> 0 then value end as v, row_number() over (order by event_id) as k from events), r as (select k, event_id, v as m, case when v is null then 0 else 1 end::double as w from e where k = 1 union all select e.k, e.event_id, case when v is null then m when m is null then v else (w * 0.4::double * m + v) / (w * 0.4::double + 1) end, w * 0.4::double + case when v is null then 0 else 1 end from r join e on e.k = r.k + 1) select event_id, round(m, 6) as x from r")
def ewm_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_events(spark, sf_dir).ewm("v", alpha=0.6, name="x").df.select("event_id", r6("x").alias("x"))


# labels and rows of several frames


@register("concat_ignore_index", "select row_number() over (order by side, k) - 1 as k, v from (select 0 as side, c_custkey as k, c_acctbal as v from customer union all select 1, s_suppkey, s_acctbal from supplier)")
def concat_ignore_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.col(k).cast("long").alias("k"), F.col(v).alias("v")) for t, k, v in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"))]
    return combine.concat_rows(parts, ignore_index="k")


# bars of weekdays and of a weekday of each month

_THIRD = "make_date(year({d})::bigint, month({d})::bigint, 1) + ((4 - (isodow(make_date(year({d})::bigint, month({d})::bigint, 1)) - 1) + 7) % 7 + 14)::int"
_HERE, _BEFORE = _THIRD.format(d="o_orderdate"), _THIRD.format(d="(date_trunc('month', o_orderdate) - interval 1 month)")
register("resample_third_friday", _CAL.format(b=f"case when o_orderdate::date >= {_HERE} then {_HERE} else {_BEFORE} end::timestamp"))(_calendar(O.week_of_month(1, 2, 4)))
_ORD = "(5 * floor(({d}::date - date '1969-12-29') / 7) + least(({d}::date - date '1969-12-29') % 7, 4))::bigint"
_FIRST = _ORD.format(d="(select min(o_orderdate) from orders)")
_START = f"({_FIRST} + 3 * (({_ORD.format(d='o_orderdate')} - {_FIRST}) // 3))"
register("resample_three_business_days", _CAL.format(b=f"(date '1969-12-29' + (7 * ({_START} // 5) + {_START} % 5)::int)::timestamp"))(_calendar(O.bday(3)))


# SQL with time zones


@register("sql_self_at_time_zone", "select event_id, (ts at time zone 'UTC') at time zone 'America/New_York' as ny, hour((ts at time zone 'UTC') at time zone 'Asia/Tokyo') as h from events")
def sql_at_time_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "ts")
    return query(df, "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny, CAST(hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo') AS bigint) AS h FROM self")


# files written and read back


def _files(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = Frame(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), "p_partkey")
        path = shared_path(spark, kind)
        df = files.with_index(f, index_label="row")
        schema = df.schema
        if kind == "parquet":
            files.write_parquet(df, path)
            back = files.read_parquet(spark, path, ["p_name", "row", "p_size", "p_retailprice"])
        elif kind == "csv":
            files.write_csv_file(df, path, "|")
            back = files.read_csv_file(spark, path, "|", schema=schema)
        else:
            df.write.json(path)
            back = files.read_json_file(spark, path, schema)
        return files.indexed(back, "row").df

    return run


for _kind in ("parquet", "csv", "json"):
    register(f"files_{_kind}", "select p_partkey as row, p_name, p_size, p_retailprice from part")(_files(_kind))


# offsets on tables

_NEXT = {
    "month_start": (O.month_start(), "date_trunc('month', o_orderdate) + interval 1 month"),
    "quarter_start": (O.quarter_start(), "date_trunc('quarter', o_orderdate) + interval 3 month"),
    "quarter_end": (O.quarter_end(), "date_trunc('quarter', o_orderdate + interval 1 day) + interval 3 month - interval 1 day"),
    "year_start": (O.year_start(), "date_trunc('year', o_orderdate) + interval 1 year"),
    "year_end": (O.year_end(), "date_trunc('year', o_orderdate + interval 1 day) + interval 1 year - interval 1 day"),
    "two_weeks": (O.Week(2), "o_orderdate + interval 14 day"),
    "friday": (O.Week(1, 4), "o_orderdate + to_days(((4 - (isodow(o_orderdate) - 1) + 6) % 7 + 1)::int)"),
    "five_hours": (O.hours(5), "o_orderdate + interval 5 hour"),
    "months_and_days": (O.date_offset(months=1, days=3), "o_orderdate + interval 1 month + interval 3 day"),
}
for _name, (_rule, _sql) in _NEXT.items():

    def _moved(spark: SparkSession, sf_dir: str, rule: O.Offset = _rule) -> DataFrame:
        return table(spark, sf_dir, "orders").select("o_orderkey", rule.column(F.col("o_orderdate").cast(NTZ)).cast(NTZ).alias("t"))

    register(f"offset_{_name}", f"select o_orderkey, ({_sql})::timestamp as t from orders")(_moved)


# generated labels


@register("date_range_ticks", "select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-03-01', interval 90 minute)) as index")
def date_range_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.date_range(spark, dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1), offset=O.minutes(90)).select(F.col("index").cast(NTZ).alias("index"))


@register("date_range_month_ends", "select (d + interval 1 month - interval 1 day)::timestamp as index from (select unnest(generate_series(timestamp '2020-01-01', timestamp '2024-12-01', interval 1 month)) as d)")
def date_range_month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.date_range(spark, dt.datetime(2020, 1, 1), dt.datetime(2024, 12, 31), offset="ME")


@register("from_range_down", "select 1000 - 7 * k as index from (select unnest(generate_series(0, 142)) as k)")
def from_range_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.from_range(spark, 1000, 0, -7)
