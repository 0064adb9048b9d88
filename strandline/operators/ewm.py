"""Exponentially weighted statistics, with the recursion of pandas: adjust, ignore_na, min_periods, bias.

`ewm` runs on blocks of positions, each preceded by the rows that still count; `ewm_folded` gathers a key's values into
an array and folds it inside the JVM, for short keys.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import ship
from .position import BLOCK, filled, running, with_position


@dataclass(frozen=True)
class Decay:
    """Exactly one of com, span, halflife, alpha."""

    com: float | None = None
    span: float | None = None
    halflife: float | None = None
    alpha: float | None = None
    min_periods: int = 0
    adjust: bool = True
    ignore_na: bool = False

    @property
    def rate(self) -> float:
        given = [x for x in (self.com, self.span, self.halflife, self.alpha) if x is not None]
        if len(given) != 1:
            raise ValueError("give exactly one of com, span, halflife and alpha")
        if self.alpha is not None:
            a = self.alpha
        elif self.com is not None:
            a = 1 / (1 + self.com)
        elif self.span is not None:
            a = 2 / (1 + self.span)
        else:
            a = 1 - math.exp(-math.log(2) / self.halflife)
        if not 0 < a <= 1:
            raise ValueError("the decay is out of range")
        return a


def mean_fold(values: Column, d: Decay) -> Column:
    """Array of weighted means of an array of doubles, in order."""
    a, new = d.rate, 1.0 if d.adjust else d.rate
    keep = 1 - a
    age = "s.ow" if d.ignore_na else f"s.ow * {keep!r}D"
    least = max(d.min_periods, 1)
    w = f"case when x is null then s.w when s.w is null then x else (s.ow * {keep!r}D * s.w + {new!r}D * x) / (s.ow * {keep!r}D + {new!r}D) end"
    ow = f"case when x is null then (case when s.w is null then s.ow else {age} end) when s.w is null then 1D else " + (f"s.ow * {keep!r}D + {new!r}D" if d.adjust else "1D") + " end"
    n = "s.n + if(x is null, 0, 1)"
    return _fold(values, "struct(cast(null as double) as w, 1D as ow, 0 as n, cast(array() as array<double>) as out)", f"struct({w} as w, {ow} as ow, {n} as n, array_append(s.out, if({n} >= {least}, {w}, null)) as out)")


def sum_fold(values: Column, d: Decay) -> Column:
    """Array of decayed sums: each step decays the sum (a null only ages it) and adds the value."""
    keep = 1 - d.rate
    least = max(d.min_periods, 1)
    aged = "s.w" if d.ignore_na else f"s.w * {keep!r}D"
    w = f"case when x is null then {aged} else s.w * {keep!r}D + x end"
    n = "s.n + if(x is null, 0, 1)"
    return _fold(values, "struct(0D as w, 0 as n, cast(array() as array<double>) as out)", f"struct({w} as w, {n} as n, array_append(s.out, if({n} >= {least}, {w}, null)) as out)")


def _fold(values: Column, start: str, step: str) -> Column:
    del values  # the lambda reads the column by name
    return F.expr(f"aggregate(__values, {start}, (s, x) -> {step}, s -> s.out)")


def ewm_folded(df: DataFrame, value: str, order: list[str], keys: list[str], d: Decay, stat: str = "mean", name: str | None = None) -> DataFrame:
    """df with the weighted mean or sum of a column in order within keys, inside the JVM; for keys of up to some thousand rows, as each step copies the array."""
    if stat not in ("mean", "sum"):
        raise ValueError(f"no fold for {stat!r}")
    name = name or f"ewm_{stat}"
    rows = df.select(*keys, F.struct(*order, F.struct(*[c for c in df.columns]).alias("__row"), F.col(value).cast("double").alias("__x")).alias("__r"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("__r")).alias("__rows"))
    listed = listed.withColumn("__values", F.transform("__rows", lambda r: r["__x"]))
    folded = listed.withColumn("__out", mean_fold(F.col("__values"), d) if stat == "mean" else sum_fold(F.col("__values"), d))
    pairs = folded.select(F.explode(F.arrays_zip("__rows", "__out")).alias("p"))
    return pairs.select("p.__rows.__row.*", F.col("p.__out").alias(name))


E_FOLDS = 42.0  # a weight that fell by so many is below the rounding of a double


def _scan(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """s[i] = c[i] * s[i - 1] + d[i] from s[-1] = 0, for 0 <= c <= 1: sums of d over the running product, so far as that is no tiny number."""
    out, s, at = np.empty(len(d)), 0.0, 0
    logs = np.cumsum(np.log(np.maximum(c, 1e-300)))
    while at < len(d):
        s = out[at] = c[at] * s + d[at]
        end = int(np.searchsorted(-logs, 230 - logs[at], side="right"))
        if end > at + 1:
            fell = np.exp(logs[at + 1 : end] - logs[at])
            out[at + 1 : end] = fell * (s + np.cumsum(d[at + 1 : end] / fell))
            s = out[end - 1]
        at = max(end, at + 1)
    return out


def _weighted(x: np.ndarray, y: np.ndarray, gaps: np.ndarray, first: np.ndarray, d: Decay, stat: str, bias: bool) -> np.ndarray:
    """The statistic after each of these valid rows; gaps: steps since the last valid row, first: whether a row begins its key."""
    aged = np.where(first, 0.0, (1 - d.rate) ** gaps)
    if stat == "sum":
        return _scan(aged, x)
    if d.adjust:
        total = _scan(aged, np.ones(len(x)))
        c = aged * np.concatenate([[0.0], total[:-1]]) / total
    else:
        c = aged / (aged + d.rate)
    c = np.where(first, 0.0, c)
    mean = lambda v: _scan(c, (1 - c) * v)
    mx, my = mean(x), mean(y)
    if stat == "mean":
        return mx

    off = lambda v, m: v - np.concatenate([[0.0], m[:-1]])
    dx, dy = off(x, mx), off(y, my)  # from the mean before; c is 0 where there is none
    moment = lambda u, v: _scan(c, c * (1 - c) * u * v)
    cov = moment(dx, dy)
    if stat == "corr":
        spread = moment(dx, dx) * moment(dy, dy)
        return np.where(spread > 0, cov / np.sqrt(np.where(spread > 0, spread, 1.0)), np.nan)
    if not bias:
        squares = _scan(c * c, (1 - c) ** 2)  # of the weights, as shares of their sum
        cov = np.where(squares < 1, cov / np.where(squares < 1, 1 - squares, 1.0), np.nan)
    return np.sqrt(np.maximum(cov, 0.0)) if stat == "std" else cov


def ewm(df: DataFrame, value: str, order: list[str], keys: list[str], d: Decay, stat: str, name: str | None = None, other: str | None = None, bias: bool = False, block: int = BLOCK) -> DataFrame:
    """df with mean, sum, var, std, cov or corr (cov and corr against `other`) in order, within keys if there are any.

    Valid rows are taken in blocks of positions. Each block is preceded by the rows whose weights still count at its
    start, so a key of any size is split; a block grows only where the decay reaches beyond it. Nulls and NaN are
    missing values: their rows take the result of the last valid one, a sum's decayed by the rows since.
    """
    if stat not in ("mean", "sum", "var", "std", "cov", "corr"):
        raise ValueError(f"unknown statistic {stat!r}")
    if stat in ("cov", "corr") and other is None:
        raise ValueError(f"{stat} needs another column")
    name = name or f"ewm_{stat}"
    ship(df.sparkSession)
    keep = 1 - d.rate
    reach = max(math.ceil(E_FOLDS / -math.log(keep)) if keep > 0 else 1, d.min_periods, 1)
    block = max(block, reach)
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = with_position(df, [*keys, *order], "__pos").withColumns({"__x": number(value), "__y": number(other or value)})
    missing = F.col("__x").isNull() | F.col("__y").isNull()
    gaps = not rows.where(missing).isEmpty()
    if gaps:
        rows = running(rows, "__pos", {"__rank": (F.when(missing, 0).otherwise(1), F.sum, operator.add)})
        valid = rows.where(~missing).withColumn("__rank", F.col("__rank") - 1)
    else:
        valid = rows.withColumn("__rank", F.col("__pos"))
    own = F.floor(F.col("__rank") / block)
    late = F.pmod(F.col("__rank"), F.lit(block)) >= block - reach
    spread = valid.withColumn("__own", own).withColumn("__block", F.explode(F.array_compact(F.array(own, F.when(late, own + 1)))))
    spread = spread.withColumn("__mine", F.col("__own") == F.col("__block")).drop("__own", "__rank")
    held = [*df.columns, "__pos", "__x", "__y"]
    schema = StructType([*[spread.schema[c] for c in held], StructField(name, DoubleType())])

    def run(pdf):
        pdf = pdf.sort_values("__pos", kind="stable").reset_index(drop=True)
        key = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), int)
        first = np.concatenate([[True], key[1:] != key[:-1]])
        steps = np.diff(pdf["__pos"].to_numpy(), prepend=0) if not d.ignore_na else np.ones(len(pdf))
        out = _weighted(pdf["__x"].to_numpy(), pdf["__y"].to_numpy(), steps.astype("float64"), first, d, stat, bias)
        at = np.arange(len(pdf))
        seen = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
        pdf[name] = np.where(seen >= d.min_periods, out, np.nan)
        return pdf.loc[pdf["__mine"], [*held, name]]

    out = spread.groupBy("__block").applyInPandas(run, schema)
    out = out.withColumn(name, F.nanvl(name, F.lit(None).cast("double")))
    if not gaps:
        return out.select(*df.columns, name)
    label = F.struct(F.lit(0).alias("k"), *keys)
    both = out.unionByName(rows.where(missing).select(*held, F.lit(None).cast("double").alias(name)))
    last = F.when(~missing, F.struct(label.alias("key"), F.col("__pos").alias("at"), F.col(name).alias("v")))
    both = filled(both, "__pos", {"__last": last})
    v = F.col("__last")["v"]
    if stat == "sum" and not d.ignore_na:
        v = v * F.pow(F.lit(keep), F.col("__pos") - F.col("__last")["at"])
    return both.withColumn(name, F.when(F.col("__last")["key"].eqNullSafe(label), v)).select(*df.columns, name)
