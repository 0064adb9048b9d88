"""Rolling, expanding and lag-family windows over ordered, optionally keyed rows.

Each function returns Column expressions for a Window, so that several share one sort. A rolling frame of w rows ends
at the current row; `closed` left, both and neither shift its ends, `center` moves it half a window ahead. A value
is null with fewer than min_periods valid rows in its frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window


@dataclass(frozen=True)
class Rolling:
    size: int
    min_periods: int | None = None
    center: bool = False
    closed: str = "right"
    step: int = 1

    def bounds(self) -> tuple[int, int]:
        """First and last row of the frame, relative to the current one."""
        shift = (self.size - 1) // 2 if self.center else 0
        first = -self.size if self.closed in ("left", "both") else -(self.size - 1)
        last = -1 if self.closed in ("left", "neither") else 0
        return first + shift, last + shift

    def frame(self, w: WindowSpec) -> WindowSpec:
        return w.rowsBetween(*self.bounds())

    @property
    def least(self) -> int:
        return self.size if self.min_periods is None else self.min_periods


@dataclass(frozen=True)
class Expanding:
    min_periods: int = 1

    def frame(self, w: WindowSpec) -> WindowSpec:
        return w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def least(self) -> int:
        return self.min_periods


def _product(c: Column, w: WindowSpec) -> Column:
    d = c.cast("double")
    logs = F.sum(F.when(d != 0, F.ln(F.abs(d)))).over(w)
    minus = F.sum(F.when(d < 0, 1).otherwise(0)).over(w)
    zeros = F.sum(F.when(d == 0, 1).otherwise(0)).over(w)
    return F.when(zeros > 0, F.lit(0.0)).otherwise(F.exp(F.coalesce(logs, F.lit(0.0))) * F.when(minus % 2 == 0, 1.0).otherwise(-1.0))


def agg(name: str, c: Column, spec: Rolling | Expanding, w: WindowSpec, skip_nulls: bool = True, ddof: int = 1, q: float = 0.5, interpolation: str = "linear", value=None, other: Column | None = None) -> Column:
    """One windowed aggregate by name, null where the frame has too few valid rows (or any null, without skip_nulls)."""
    f = spec.frame(w)
    valid = c.isNotNull() if other is None else c.isNotNull() & other.isNotNull()
    n = F.count(F.when(valid, 1)).over(f)
    if name == "product" and isinstance(spec, Rolling):  # a bounded frame's values, multiplied in order
        out = F.aggregate(F.collect_list(c.cast("double")).over(f), F.lit(1.0), lambda a, b: a * b)
    elif name == "product":
        out = _product(c, f)
    elif name in ("first", "last"):
        out = getattr(F, name)(c, ignorenulls=True).over(f)
    elif name in ("all", "any"):
        out = (F.bool_and if name == "all" else F.bool_or)(c).over(f)
    elif name in ("stddev", "variance"):
        pop = F.var_pop(c).over(f)
        var = F.var_samp(c).over(f) if ddof == 1 else pop if ddof == 0 else F.when(n > ddof, pop * n / (n - ddof))
        out = F.sqrt(var) if name == "stddev" else var
    elif name in ("quantile", "approximate_median", "tdigest"):
        p = 0.5 if name == "approximate_median" else q
        out = F.percentile(c, F.lit(p)).over(f) if interpolation == "linear" else quantile_of(F.array_sort(F.collect_list(c).over(f)), p, interpolation)
    elif name == "index":
        seen = F.collect_list(F.coalesce(c == F.lit(value), F.lit(False))).over(f)
        at = F.array_position(seen, True)
        out = F.when(at > 0, at - 1)
    elif name in ("cov", "corr"):
        x, y = F.when(valid, c), F.when(valid, other)
        spread = F.sqrt(F.var_pop(x).over(f)) * F.sqrt(F.var_pop(y).over(f))
        out = F.covar_samp(x, y).over(f) if name == "cov" else F.try_divide(F.covar_pop(x, y).over(f), spread)
    elif name in ("sum", "mean", "min", "max", "count"):
        out = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[name](c).over(f)
    else:
        raise ValueError(f"unknown window aggregate {name!r}")
    enough = (n >= max(spec.least, 1)) if name != "count" else (n >= spec.least)
    if not skip_nulls:
        enough = enough & (n == F.count(F.lit(1)).over(f))
    return F.when(enough, out)


def quantile_of(values: Column, q: float, interpolation: str) -> Column:
    """Quantile of a sorted array without nulls: lower, higher, nearest, midpoint or linear."""
    n = F.size(values)
    at = (n - 1) * F.lit(float(q))
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(values, low).cast("double"), F.get(values, high).cast("double")
    near = F.get(values, F.bround(at).cast("int")).cast("double")
    out = {"lower": a, "higher": b, "nearest": near, "midpoint": (a + b) / 2, "linear": a + (b - a) * (at - low)}
    if interpolation not in out:
        raise ValueError(f"unknown interpolation {interpolation!r}")
    return F.when(n > 0, out[interpolation])


def shift(c: Column, n: int, w: WindowSpec) -> Column:
    return F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)


def diff(c: Column, n: int, w: WindowSpec) -> Column:
    return c - shift(c, n, w)


def pct_change(c: Column, n: int, w: WindowSpec) -> Column:
    before = shift(c, n, w)
    return F.try_divide((c - before).cast("double"), before.cast("double"))


def cumulative(name: str, c: Column, w: WindowSpec, skip_nulls: bool = True, start=None) -> Column:
    """Running sum, prod, mean, max or min; null rows stay null, and without skip_nulls all rows from the first null on."""
    f = w.rowsBetween(Window.unboundedPreceding, 0)
    if name == "prod":
        out = _product(c, f)
    elif name in ("sum", "mean", "max", "min"):
        out = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[name](c).over(f)
    else:
        raise ValueError(f"unknown cumulative {name!r}")
    if start is not None:
        s = F.lit(start)
        n = F.count(c).over(f)
        out = {"sum": lambda: out + s, "prod": lambda: out * s, "max": lambda: F.greatest(out, s), "min": lambda: F.least(out, s), "mean": lambda: (out * n + s) / (n + 1)}[name]()
    if skip_nulls:
        return F.when(c.isNotNull(), out)
    return F.when(F.count(F.when(c.isNull(), 1)).over(f) == 0, out)


def ffill(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def bfill(c: Column, keys: list[str], order: list[str]) -> Column:
    """The fill in reverse order: Spark reads a frame to the end anew for each row, which takes the square of a key's rows."""
    return ffill(c, Window.partitionBy(*keys).orderBy(*[F.desc(x) for x in order]))


RANKINGS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


def ranking(name: str, w: WindowSpec) -> Column:
    return RANKINGS[name]().over(w)
