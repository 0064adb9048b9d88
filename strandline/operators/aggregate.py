"""Aggregates by name: down the rows of a frame or group, and across the columns of a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .position import with_position
from .windows import quantile_of


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _as_long(df: DataFrame, name: str) -> Column | None:
    kind = df.schema[name].dataType.simpleString()
    if kind in _WHOLE:
        return F.col(name).cast("bigint")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.datediff(F.col(name), F.lit("1970-01-01")).cast("bigint") if kind == "date" else None


def order_key(df: DataFrame, order: list[str]) -> Column:
    """One value that sorts as the order columns do, for first and last.

    Two columns of whole numbers or times become one decimal, which a hash aggregate can hold; a struct would make it
    sort its input by key. Null parts come first.
    """
    if len(order) == 1:
        return F.col(order[0])
    parts = [_as_long(df, c) for c in order]
    if len(order) != 2 or any(p is None for p in parts):
        return F.struct(*order)
    high, low = (F.coalesce(p, F.lit(-(2**63))).cast("decimal(19,0)") for p in parts)
    return high * F.lit("1" + "0" * 19).cast("decimal(20,0)") + low


def _variance(c: Column, ddof: int) -> Column:
    if ddof == 1:
        return F.var_samp(c)
    n = F.count(c)
    return F.var_pop(c) if ddof == 0 else F.when(n > ddof, F.var_pop(c) * n / (n - ddof))


def _covariance(a: Column, b: Column, ddof: int, least: int) -> Column:
    n = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    cov = F.covar_samp(a, b) if ddof == 1 else F.covar_pop(a, b) * n / (n - ddof)
    return F.when((n > ddof) & (n >= least), cov)


def _exact_mean(c: Column) -> Column:
    """The mean of doubles, whose sum is kept as a decimal with ten places and what is left over, so that it neither drifts nor depends on the rows' order."""
    c = c.cast("double")
    high = F.when(F.abs(c) < 1e17, c).cast("decimal(28,10)")
    rest = c - F.coalesce(high.cast("double"), F.lit(0.0))
    return (F.coalesce(F.sum(high).cast("double"), F.lit(0.0)) + F.sum(rest)) / F.when(F.count(c) > 0, F.count(c))


def down(name: str, c: Column, order: Column | None = None, skip_nulls: bool = True, min_count: int = 0, ddof: int | None = None, q: float = 0.5, interpolation: str = "linear", value=None, pos: Column | None = None, other: Column | None = None, min_periods: int = 1, exact: bool = False) -> Column:
    """One aggregate expression. first and last need `order`; index and idx_min/idx_max need `pos`.

    ddof is 0 for variances and 1 for covariances where it is not given; a covariance of fewer than min_periods pairs is null.
    An exact mean is one of doubles whose sum does not drift, at the price of a decimal sum.

    skip_nulls=False makes the result null when any value is; so does min_count with fewer valid values.
    """
    if name in ("first", "last"):
        at = order if order is not None else F.lit(0)
        at = F.when(c.isNotNull(), at) if skip_nulls else at
        return (F.min_by if name == "first" else F.max_by)(c, at)
    simple = {
        "sum": lambda: F.sum(c),
        "mean": lambda: _exact_mean(c) if exact else F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "product": lambda: F.product(c.cast("double")),
        "all": lambda: F.bool_and(c),
        "any": lambda: F.bool_or(c),
        "variance": lambda: _variance(c, ddof or 0),
        "stddev": lambda: F.sqrt(_variance(c, ddof or 0)),
        "median": lambda: F.median(c),
        "approximate_median": lambda: F.percentile_approx(c, 0.5),
        "tdigest": lambda: F.percentile_approx(c, q, 10_000),
        "quantile": lambda: F.percentile(c, q) if interpolation == "linear" else quantile_of(F.array_sort(F.collect_list(c)), q, interpolation),
        "kurtosis": lambda: F.kurtosis(c),
        "skewness": lambda: F.skewness(c),
        "idx_min": lambda: F.min_by(pos, F.when(c.isNotNull(), F.struct(c, pos))),
        "idx_max": lambda: -F.max_by(-pos, F.when(c.isNotNull(), F.struct(c, -pos))),
        "cov": lambda: _covariance(c, other, 1 if ddof is None else ddof, min_periods),
        "corr": lambda: F.corr(c, other),
    }
    plain = {
        "count_all": lambda: F.count(F.lit(1)),
        "count_valid": lambda: F.count(c),
        "count": lambda: F.count(c),
        "count_null": lambda: F.count_if(c.isNull()),
        "count_distinct": lambda: F.count_distinct(c),
        "approx_count_distinct": lambda: F.approx_count_distinct(c),
        "index": lambda: F.min(F.when(c.eqNullSafe(F.lit(value)), pos)),
    }
    if name in plain:
        return plain[name]()
    if name not in simple:
        raise ValueError(f"unknown aggregate {name!r}")
    out = simple[name]()
    if not skip_nulls:
        out = F.when(F.count(c) == F.count(F.lit(1)), out)
    return F.when(F.count(c) >= min_count, out) if min_count > 0 else out


def across(name: str, cols: list[Column], q: float = 0.5, interpolation: str = "linear", ddof: int = 0, value=None) -> Column:
    """One value for each row over its columns, nulls skipped."""
    some = F.coalesce(*cols).isNotNull()
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    if name == "sum":
        return F.when(some, total)
    if name == "mean":
        return F.when(some, total / n)
    if name == "product":
        return F.when(some, reduce(lambda a, b: a * b, [F.coalesce(c.cast("double"), F.lit(1.0)) for c in cols]))
    if name in ("min", "max"):
        return (F.least if name == "min" else F.greatest)(*cols) if len(cols) > 1 else cols[0]
    if name in ("first", "last"):
        return F.coalesce(*(cols if name == "first" else cols[::-1]))
    if name in ("all", "any"):
        kept = [F.coalesce(c, F.lit(name == "all")) for c in cols]
        return F.when(some, reduce((lambda a, b: a & b) if name == "all" else (lambda a, b: a | b), kept))
    if name == "count_valid":
        return n
    if name == "count_null":
        return F.lit(len(cols)) - n
    if name == "count_all":
        return F.lit(len(cols))
    if name in ("variance", "stddev"):
        mean = total / n
        square = reduce(lambda a, b: a + b, [F.coalesce(F.pow(c.cast("double") - mean, F.lit(2)), F.lit(0.0)) for c in cols])
        var = F.when(n > ddof, square / (n - ddof))
        return F.sqrt(var) if name == "stddev" else var
    if name in ("quantile", "approximate_median", "median"):
        values = F.array_sort(F.array_compact(F.array(*[c.cast("double") for c in cols])))
        return quantile_of(values, q if name == "quantile" else 0.5, interpolation)
    if name == "index":
        at = F.array_position(F.array(*cols), F.lit(value))
        return F.when(at > 0, at - 1)
    raise ValueError(f"unknown aggregate {name!r}")


def agg_columns(df: DataFrame, names: list[str], values: list[str], by: list[str] | None = None, order: list[str] | None = None, **options) -> DataFrame:
    """Every aggregate of every value column, for the frame or each key; `value_name` columns where several are asked for."""
    at = order_key(df, order) if order else None
    cols = [down(n, F.col(v), order=at, **options).alias(v if len(names) == 1 else f"{v}_{n}") for v in values for n in names]
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def mode(df: DataFrame, value: str, by: list[str] | None = None, n: int = 1, skip_nulls: bool = True) -> DataFrame:
    """The n most frequent values (keys, value, count, rank); of equals the smaller first."""
    by = by or []
    rows = df.where(F.col(value).isNotNull()) if skip_nulls else df
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("count"))
    order = [F.desc("count"), F.asc_nulls_last(value)]
    if not by:
        return counts.orderBy(*order).limit(n)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def quantiles(df: DataFrame, value: str, q: float, by: list[str] | None = None, interpolation: str = "linear") -> DataFrame:
    """Exact quantile of a column's valid values, for the frame or each key, by linear, lower, higher, nearest or midpoint.

    Values are ranked by a range-partitioned sort and the two rows beside the quantile picked by position, so that no
    task holds a group. A key without valid values, and an empty frame, give no row and one null.
    """
    by = by or []
    ranked = with_position(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")), [*by, "__v"], "__pos")
    sizes = ranked.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__pos").alias("__first"))
    sizes = sizes.select(*[F.col(c).alias(f"__k_{c}") for c in by], "__first", ((F.col("__n") - 1) * F.lit(float(q))).alias("__at"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by], F.lit(True))
    at, place = F.col("__at"), F.col("__pos") - F.col("__first")
    joined = ranked.join(sizes if by else F.broadcast(sizes), same)
    low, high, near = (F.max(F.when(place == f(at), F.col("__v"))) for f in (F.floor, F.ceil, F.bround))
    ways = {"lower": low, "higher": high, "nearest": near, "midpoint": (low + high) / 2, "linear": low + (high - low) * (F.max(at) - F.floor(F.max(at)))}
    if interpolation not in ways:
        raise ValueError(f"unknown interpolation {interpolation!r}")
    beside = joined.where((place >= F.floor(at)) & (place <= F.ceil(at)))
    return beside.groupBy(*by).agg(ways[interpolation].alias(value))
