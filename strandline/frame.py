"""Frame: a DataFrame with index columns, a total order and optional partition keys.

Nothing runs until a result is asked for; only scalar lookups and data-dependent origins start jobs. Operations on
frames of one lineage are plain selections; others align by a full outer join on the index.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from .functions import logic as L
from .functions import math as M
from .operators import aggregate, combine, ewm, resample, select, windows
from .operators.position import filled, over_blocks, running, with_position
from .plans.sql import query
from .storage import ship

PLAIN = dict.fromkeys(("byte", "short", "integer", "long"), "int64") | {"float": "float64", "double": "float64", "boolean": "bool"}


class Frame:
    """df: the rows. index: label columns. order: columns of a total order (the index by default). keys: partition columns."""

    def __init__(self, df: DataFrame, index: list[str] | str = (), order: list[str] | str | None = None, keys: list[str] | str = (), lineage: object | None = None):
        as_list = lambda x: [x] if isinstance(x, str) else list(x)
        self.df, self.index, self.keys = df, as_list(index), as_list(keys)
        self.order = as_list(order) if order is not None else self.index
        self.lineage = lineage or object()
        for c in [*self.index, *self.order, *self.keys]:
            if c not in df.columns:
                raise KeyError(c)
        if len(set(df.columns)) < len(df.columns):
            raise ValueError("column names repeat")

    def _new(self, df: DataFrame, same: bool = False, **kw: Any) -> Frame:
        args = {"index": self.index, "order": self.order, "keys": self.keys} | kw
        return Frame(df, **args, lineage=self.lineage if same else None)

    @property
    def columns(self) -> list[str]:
        """Data columns: all but the index."""
        return [c for c in self.df.columns if c not in self.index]

    @property
    def values(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys and c not in self.order]

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    def empty(self) -> bool:
        return self.df.isEmpty()

    def contains(self, column: str) -> bool:
        return column in self.columns

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    # projection and shape

    def __getitem__(self, item: str | list[str] | Callable) -> Frame:
        names = item(self.columns) if callable(item) else [item] if isinstance(item, str) else list(item)
        held = dict.fromkeys([*self.index, *self.keys, *self.order, *names])
        return self._new(self.df.select(*held), same=True)

    def assign(self, **cols: Column | Frame) -> Frame:
        """Columns set or added, last. A frame of the same lineage may be given by its one value column's expression."""
        out = self.df
        for name, c in cols.items():
            out = out.select(*[x for x in out.columns if x != name], c.alias(name))
        return self._new(out)

    def update(self, changes: Frame) -> Frame:
        return self._new(combine.update(self.df, changes.df, self.index, [c for c in changes.order if c in changes.df.columns]))

    def drop(self, *names: str) -> Frame:
        for n in names:
            if n not in self.columns:
                raise KeyError(n)
        return self._new(self.df.drop(*names))

    def rename(self, names: dict[str, str]) -> Frame:
        move = lambda cs: [names.get(c, c) for c in cs]
        return self._new(self.df.withColumnsRenamed(names), index=move(self.index), order=move(self.order), keys=move(self.keys))

    def add_prefix(self, prefix: str) -> Frame:
        return self.rename({c: prefix + c for c in self.columns})

    def add_suffix(self, suffix: str) -> Frame:
        return self.rename({c: c + suffix for c in self.columns})

    def set_index(self, *names: str) -> Frame:
        return self._new(self.df, index=list(names))

    def reset_index(self) -> Frame:
        """The index becomes ordinary columns, last; order stays."""
        return self._new(self.df.select(*self.columns, *self.index), index=[])

    def sort_columns(self, ascending: bool = True) -> Frame:
        return self._new(self.df.select(*self.index, *sorted(self.columns, reverse=not ascending)), same=True)

    def cast(self, types: dict[str, str], safe: bool = True) -> Frame:
        cols = {c: F.col(c).cast(t) if safe else F.col(c).try_cast(t) for c, t in types.items()}
        return self._new(self.df.withColumns(cols))

    def flatten(self) -> DataFrame:
        """All values in row order as one column: double where all are numbers, else text unless all are of one type."""
        rows = with_position(self.df, self.order, "__pos")
        kinds = {self.df.schema[c].dataType.simpleString() for c in self.values}
        number = all(isinstance(self.df.schema[c].dataType, NumericType) for c in self.values)
        kind = "double" if number else kinds.pop() if len(kinds) == 1 else "string"
        cells = F.posexplode(F.array(*[F.col(c).cast(kind) for c in self.values]))
        return rows.select("__pos", cells.alias("__k", "value")).orderBy("__pos", "__k").select("value")

    def transpose_series(self, value: str) -> DataFrame:
        """Labels as columns of one row."""
        return self.df.groupBy().pivot(self.index[0]).agg(F.first(value))

    # rows

    def head(self, n: int = 10) -> Frame:
        return self._new(select.head(self.df, self.order, n))

    def tail(self, n: int = 10) -> Frame:
        return self._new(select.tail(self.df, self.order, n))

    def iloc(self, rows: slice | list[int]) -> Frame:
        if isinstance(rows, slice):
            return self._new(select.iloc(self.df, self.order, rows.start, rows.stop, rows.step or 1))
        return self._new(select.take(self.df, self.order, rows))

    def row(self, k: int) -> dict[str, Any]:
        got = select.take(self.df, self.order, [k]).first()
        if got is None:
            raise IndexError(k)
        return got.asDict()

    def loc(self, what: Any) -> Frame:
        """A mask column, a callable giving one, a slice of labels (both ends in), a table of labels or one label."""
        if callable(what) and not isinstance(what, Column):
            what = what(self)
        if isinstance(what, Column):
            return self._new(self.df.where(what))
        if isinstance(what, slice):
            return self._new(select.loc_slice(self.df, self.index[0], what.start, what.stop))
        if isinstance(what, DataFrame):
            return self._new(select.loc_labels(self.df, self.index[0], what))
        return self._new(select.loc(self.df, self.index[0], what))

    def at(self, label: Any, column: str) -> Any:
        """The value at a label, the last of repeated ones."""
        got = select.loc(self.df, self.index[0], label).orderBy(*[F.desc(c) for c in self.order]).first()
        if got is None:
            raise KeyError(label)
        return got[column]

    def where(self, cond: Column, other: Any = None) -> Frame:
        cols = {c: L.where(cond, F.col(c), other if isinstance(other, Column) else F.lit(other)) for c in self.values}
        return self._new(self.df.withColumns(cols))

    def isin(self, values: list) -> Frame:
        return self._new(self.df.withColumns({c: L.isin(F.col(c), values) for c in self.values}))

    def drop_labels(self, labels: DataFrame) -> Frame:
        return self._new(select.drop_labels(self.df, self.index[0], labels))

    def reindex(self, labels: DataFrame, fill: Any = None) -> Frame:
        return self._new(combine.reindex(self.df, labels, self.index[0], fill), order=self.index, keys=[])

    def drop_null(self, how: str = "any", thresh: int | None = None, subset: list[str] | None = None) -> Frame:
        return self._new(select.drop_null(self.df, how, thresh, subset))

    def fill_null(self, value: Any) -> Frame:
        return self._new(select.fill_null(self.df, value, self.values))

    def _filled(self, order: list) -> Frame:
        return self._new(filled(with_position(self.df, order, "__pos"), "__pos", {c: F.col(c) for c in self.values}).drop("__pos"))

    def ffill(self) -> Frame:
        if not self.keys:
            return self._filled(self.order)
        return self._windowed({c: lambda w, c=c: windows.ffill(F.col(c), w) for c in self.values})

    def bfill(self) -> Frame:
        if not self.keys:
            return self._filled([F.desc(c) for c in self.order])
        return self._new(self.df.withColumns({c: windows.bfill(F.col(c), self.keys, self.order) for c in self.values}))

    def _windowed(self, cols: dict[str, Callable[[WindowSpec], Column]]) -> Frame:
        """Unbounded frames: by key; over a frame without keys they need all rows in one task, so keys are asked for."""
        if not self.keys:
            raise ValueError("give the frame keys, or use running() on positions")
        w = self._window()
        return self._new(self.df.withColumns({c: f(w) for c, f in cols.items()}))

    # element-wise

    def _binary(self, other: Any, op: Callable[[Column, Column], Column], swap: bool = False) -> Frame:
        f = (lambda a, b: op(b, a)) if swap else op
        if not isinstance(other, Frame):
            return self._new(self.df.withColumns({c: f(F.col(c), F.lit(other)) for c in self.values}), same=True)
        mine, theirs = self.df.select(*self.index, *self.values), other.df.select(*other.index, *other.values)
        out = combine.binary(mine, theirs, self.index, f)
        return Frame(out, self.index)

    def __add__(self, o: Any) -> Frame:
        return self._binary(o, M.add)

    def __radd__(self, o: Any) -> Frame:
        return self._binary(o, M.add, True)

    def __sub__(self, o: Any) -> Frame:
        return self._binary(o, M.subtract)

    def __rsub__(self, o: Any) -> Frame:
        return self._binary(o, M.subtract, True)

    def __mul__(self, o: Any) -> Frame:
        return self._binary(o, M.multiply)

    def __rmul__(self, o: Any) -> Frame:
        return self._binary(o, M.multiply, True)

    def __truediv__(self, o: Any) -> Frame:
        return self._binary(o, M.divide)

    def __rtruediv__(self, o: Any) -> Frame:
        return self._binary(o, M.divide, True)

    def __pow__(self, o: Any) -> Frame:
        return self._binary(o, M.power)

    def __neg__(self) -> Frame:
        return self.apply(M.negate)

    def __invert__(self) -> Frame:
        return self.apply(L.invert)

    def compare(self, other: Any, how: str) -> Frame:
        """eq, ne, lt, le, gt or ge."""
        return self._binary(other, getattr(operator, how))

    def and_(self, o: Any) -> Frame:
        return self._binary(o, L.and_)

    def or_(self, o: Any) -> Frame:
        return self._binary(o, L.or_)

    def xor(self, o: Any) -> Frame:
        return self._binary(o, L.xor)

    def apply(self, f: Callable[[Column], Column]) -> Frame:
        """A Column function on every value column."""
        return self._new(self.df.withColumns({c: f(F.col(c)) for c in self.values}), same=True)

    def map(self, f: Callable[[Any], Any], column: str, schema: str, ignore_nulls: bool = True) -> Frame:
        """A Python function on each value of a column, in Arrow batches."""
        ship(self.df.sparkSession)

        @F.pandas_udf(schema)
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([None if ignore_nulls and (v is None or v != v) else f(v) for v in s], dtype=object)

        return self._new(self.df.withColumn(column, run(column)))

    def apply_rows(self, f: Callable[[dict], dict], schema: str) -> DataFrame:
        """A Python function on each row as a dict, in Arrow batches."""
        ship(self.df.sparkSession)

        def run(batches):
            for pdf in batches:
                yield pd.DataFrame([f(r) for r in pdf.to_dict("records")])

        return self.df.mapInPandas(run, schema)

    # aggregates

    def agg(self, *names: str, **options: Any) -> DataFrame:
        return aggregate.agg_columns(self.df, list(names), self.values, order=self.order, **options)

    def quantile(self, column: str, q: float = 0.5, interpolation: str = "linear") -> DataFrame:
        return aggregate.quantiles(self.df, column, q, interpolation=interpolation)

    def agg_rows(self, name: str, **options: Any) -> Frame:
        """One value for each row, over its columns."""
        return self._new(self.df.select(*dict.fromkeys([*self.index, *self.keys, *self.order]), aggregate.across(name, [F.col(c) for c in self.values], **options).alias(name)))

    def group_by(self, *by: str | Column) -> Grouped:
        """By columns, or by expressions that are no columns of the frame: these become __groupby_key_0__ and so on."""
        made = {f"__groupby_key_{k}__": c for k, c in enumerate(c for c in by if isinstance(c, Column))}
        left = iter(made)
        frame = self._new(self.df.withColumns(made)) if made else self
        return Grouped(frame, [next(left) if isinstance(c, Column) else c for c in by])

    def mode(self, column: str, n: int = 1, skip_nulls: bool = True) -> DataFrame:
        return aggregate.mode(self.df, column, n=n, skip_nulls=skip_nulls)

    # windows

    def rolling(self, name: str, size: int, columns: list[str] | None = None, min_periods: int | None = None, center: bool = False, closed: str = "right", step: int = 1, **options: Any) -> Frame:
        spec = windows.Rolling(size, min_periods, center, closed, step)
        first, last = spec.bounds()
        make = lambda w: {c: windows.agg(name, F.col(c), spec, w, **options) for c in columns or self.values}
        if self.keys:
            out = self.df.withColumns(make(self._window()))
            if step > 1:
                out = out.withColumn("__k", F.row_number().over(self._window()) - 1).where(F.col("__k") % step == 0).drop("__k")
            return self._new(out)
        rows = over_blocks(with_position(self.df, self.order, "__pos"), "__pos", max(0, -first), max(0, last), make)
        if step > 1:
            rows = rows.where(F.col("__pos") % step == 0)
        return self._new(rows.drop("__pos"))

    def rolling_apply(self, f: Callable[[list], float], column: str, size: int, name: str = "applied", min_periods: int = 1, center: bool = False, closed: str = "right") -> Frame:
        """A Python function of each window's valid values (a list), in Arrow batches; null with fewer than min_periods."""
        spec = windows.Rolling(size, min_periods, center, closed)
        first, last = spec.bounds()
        gather = lambda w: {"__values": F.collect_list(column).over(spec.frame(w))}
        if self.keys:
            rows = self.df.withColumns(gather(self._window()))
        else:
            rows = over_blocks(with_position(self.df, self.order, "__pos"), "__pos", max(0, -first), max(0, last), gather).drop("__pos")
        return self._applied(rows, f, name, max(min_periods, 1))

    def rolling_apply_frame(self, f: Callable[[pd.DataFrame], dict], columns: list[str], size: int, schema: str, name: str = "applied", min_periods: int | None = None, center: bool = False, closed: str = "right") -> Frame:
        """A Python function of each window's rows (a frame of `columns`) that returns one row as a dict: a struct column.

        Null where the window has fewer rows than min_periods (the size by default).
        """
        spec = windows.Rolling(size, min_periods, center, closed)
        first, last = spec.bounds()
        gap = functools.reduce(operator.or_, [F.col(c).isNull() for c in columns])
        gather = lambda w: {"__rows": F.collect_list(F.struct(*columns)).over(spec.frame(w)), "__gaps": F.count(F.when(gap, 1)).over(spec.frame(w))}
        if self.keys:
            rows = self.df.withColumns(gather(self._window()))
        else:
            rows = over_blocks(with_position(self.df, self.order, "__pos"), "__pos", max(0, -first), max(0, last), gather, called=True).drop("__pos")
        ship(self.df.sparkSession)
        enough = F.size("__rows") >= max(spec.least, 1)
        kinds = [PLAIN.get(x.dataType.typeName()) for x in self.df.select(*columns).schema]
        whole = enough & (F.lit(None in kinds) | (F.col("__gaps") > 0))
        fields = StructType.fromDDL(schema).names

        @F.pandas_udf(schema)
        def run(lists: pd.Series, *parts: pd.Series) -> pd.DataFrame:
            """lists: windows as dicts, where a type or a null needs them; parts: elsewhere, each column's values, which are joined and cut."""
            held = parts[0].tolist() if parts else [None] * len(lists)
            there = [v is not None for v in held]
            cells = [np.concatenate(p[there].tolist()).astype(k) for p, k in zip(parts, kinds, strict=False)] if any(there) else []
            table = np.column_stack(cells) if cells and len(set(kinds)) == 1 else None
            names, made, at = pd.Index(columns), [], 0
            for v, cell in zip(lists, held, strict=True):
                if cell is None:
                    made.append({} if v is None else f(pd.DataFrame(list(v), columns=columns)))
                    continue
                end = at + len(cell)
                cut = table[at:end] if table is not None else {c: x[at:end] for c, x in zip(columns, cells, strict=True)}
                made.append(f(pd.DataFrame(cut, pd.RangeIndex(end - at), names.view())))  # labels of its own, which f may name
                at = end
            return pd.DataFrame(made, columns=fields)

        parts = [] if None in kinds else [F.when(enough & ~whole, F.col("__rows")[c]) for c in columns]
        out = rows.withColumn(name, run(F.when(whole, F.col("__rows")), *parts)).withColumn(name, F.when(enough, F.col(name)))
        return self._new(out.drop("__rows", "__gaps"))

    def expanding_apply(self, f: Callable[[list], float], column: str, name: str = "applied", min_periods: int = 1) -> Frame:
        """As rolling_apply, over all rows so far of a key; for keys of up to some thousand rows."""
        rows = self._windowed({"__values": lambda w: F.collect_list(column).over(windows.Expanding(min_periods).frame(w))}).df
        return self._applied(rows, f, name, max(min_periods, 1))

    def _applied(self, rows: DataFrame, f: Callable[[list], float], name: str, least: int) -> Frame:
        ship(self.df.sparkSession)

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([float(f(list(v))) if len(v) >= least else None for v in s], dtype="float64")

        return self._new(rows.withColumn(name, run("__values")).drop("__values"))

    def expanding(self, name: str, columns: list[str] | None = None, min_periods: int = 1, **options: Any) -> Frame:
        spec = windows.Expanding(min_periods)
        if not self.keys:
            return self._expanded(name, columns or self.values, min_periods, **options)
        return self._windowed({c: lambda w, c=c: windows.agg(name, F.col(c), spec, w, **options) for c in columns or self.values})

    def cumulative(self, name: str, columns: list[str] | None = None, skip_nulls: bool = True, start: Any = None) -> Frame:
        """Running sum, prod, mean, max or min, by key or over the whole frame; see windows.cumulative."""
        names = columns or self.values
        if self.keys:
            return self._windowed({c: lambda w, c=c: windows.cumulative(name, F.col(c), w, skip_nulls, start) for c in names})
        rows, parts = self._running("sum" if name == "mean" else name, names)
        cols = {}
        for c in names:
            out, n = F.col(parts[c]), F.col(f"{parts[c]}_n")
            if start is not None:
                s = F.lit(start)
                out = {"sum": out + s, "prod": out * s, "max": F.greatest(out, s), "min": F.least(out, s), "mean": out + s}[name]
                n = n + 1
            out = out / n if name == "mean" else out
            cols[c] = F.when(F.col(c).isNotNull() if skip_nulls else F.col(f"{parts[c]}_n") == F.col("__pos") + 1, out)
        return self._new(rows.withColumns(cols).drop("__pos", *[x for p in parts.values() for x in (p, f"{p}_n")]))

    def _running(self, name: str, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
        """Rows with __pos and, for each column, its running aggregate and (_n) count of values; the former's names."""
        ways = {"sum": (F.sum, operator.add), "prod": (lambda c: F.product(c.cast("double")), operator.mul), "max": (F.max, F.greatest), "min": (F.min, F.least)}
        if name not in ways:
            raise ValueError(f"unknown cumulative {name!r}")
        f, both = ways[name]
        parts = {c: f"__r_{c}" for c in names}
        aggs = {p: (F.col(c), f, both) for c, p in parts.items()} | {f"{p}_n": (F.when(F.col(c).isNotNull(), 1).otherwise(0), F.sum, operator.add) for c, p in parts.items()}
        return running(with_position(self.df, self.order, "__pos"), "__pos", aggs), parts

    def _expanded(self, name: str, names: list[str], least: int, ddof: int = 1) -> Frame:
        """Expanding aggregates over the whole frame: sum, product, mean, min, max, count_valid, variance, stddev."""
        how = {"product": "prod", "mean": "sum", "count_valid": "sum", "variance": "sum", "stddev": "sum"}.get(name, name)
        if name in ("variance", "stddev"):  # sums of squares about the mean of all, so that nothing cancels
            centre = dict(zip(names, self.df.agg(*[F.avg(c) for c in names]).first(), strict=True))
            apart = [(c, F.col(c).cast("double") - F.lit(centre[c] or 0.0)) for c in names]
            moved = self.df.withColumns({f"__d_{c}": d for c, d in apart} | {f"__q_{c}": d * d for c, d in apart})
            rows, parts = self._new(moved)._running("sum", [f"__{x}_{c}" for c in names for x in "dq"])
        else:
            rows, parts = self._running(how, names)
        cols = {}
        for c in names:
            p = parts[f"__d_{c}" if name in ("variance", "stddev") else c]
            n, total = F.col(f"{p}_n"), F.col(p)
            var = (F.col(parts.get(f"__q_{c}", p)) - total * total / n) / F.when(n > ddof, n - ddof)
            out = {"mean": total / n, "count_valid": n, "variance": F.greatest(var, F.lit(0.0)), "stddev": F.sqrt(F.greatest(var, F.lit(0.0)))}.get(name, total)
            cols[c] = F.when(n >= least, out)
        held = [x for p in parts.values() for x in (p, f"{p}_n")] + [x for x in parts if x.startswith("__")]
        return self._new(rows.withColumns(cols).drop("__pos", *held))

    def _lagged(self, make: Callable[[WindowSpec], dict[str, Column]], n: int) -> Frame:
        if self.keys:
            return self._new(self.df.withColumns(make(self._window())))
        rows = over_blocks(with_position(self.df, self.order, "__pos"), "__pos", max(0, n), max(0, -n), make)
        return self._new(rows.drop("__pos"))

    def shift(self, n: int = 1) -> Frame:
        return self._lagged(lambda w: {c: windows.shift(F.col(c), n, w) for c in self.values}, n)

    def diff(self, n: int = 1) -> Frame:
        return self._lagged(lambda w: {c: windows.diff(F.col(c), n, w) for c in self.values}, n)

    def pct_change(self, n: int = 1) -> Frame:
        return self._lagged(lambda w: {c: windows.pct_change(F.col(c), n, w) for c in self.values}, n)

    def ewm(self, column: str, stat: str = "mean", other: str | None = None, bias: bool = False, name: str | None = None, **decay: Any) -> Frame:
        return self._new(ewm.ewm(self.df, column, self.order, self.keys, ewm.Decay(**decay), stat, name, other, bias))

    # time

    def resample(self, freq: str, time: str | None = None, **options: Any) -> Grouped:
        time = time or self.index[0]
        o = resample.Resample(freq, **options)
        binned = self.df.withColumn(time, resample.bucket(self.df, time, o))
        frame = Frame(binned, [], [c for c in self.order if c != time] or [time], [])
        return Grouped(frame, [*self.keys, time])

    def ohlcv(self, freq: str, time: str | None = None, columns: dict[str, str] | None = None, **options: Any) -> DataFrame:
        return resample.ohlcv(self.df, time or self.index[0], resample.Resample(freq, **options), self.keys, self.order, columns)

    # order, duplicates, SQL

    def sort_values(self, *by: str, ascending: bool = True, nulls_last: bool = True) -> Frame:
        return self._new(select.sort_values(self.df, list(by), ascending, nulls_last, [c for c in self.order if c not in by]))

    def sort_index(self, ascending: bool = True, nulls_last: bool = True) -> Frame:
        return self.sort_values(*self.index, ascending=ascending, nulls_last=nulls_last)

    def n_largest(self, column: str, n: int) -> Frame:
        return self._new(select.n_largest(self.df, column, n, self.order))

    def n_smallest(self, column: str, n: int) -> Frame:
        return self._new(select.n_smallest(self.df, column, n, self.order))

    def drop_duplicates(self, subset: list[str] | None = None, keep: str | bool = "first") -> Frame:
        return self._new(select.drop_duplicates(self.df, subset or self.index, self.order, keep))

    def unique(self, column: str) -> DataFrame:
        return select.unique(self.df, column, self.order)

    def value_counts(self, column: str) -> DataFrame:
        return select.value_counts(self.df, column)

    def query(self, sql: str) -> DataFrame:
        """SQL over the data columns as the table `self`."""
        return query(self.df.select(*self.columns), sql)

    def equals(self, other: Frame, tolerance: float = 1e-9) -> bool:
        """Same index, columns in any order and values, doubles within a relative tolerance."""
        if set(self.df.columns) != set(other.df.columns):
            return False
        cells = combine.diff_frames(self.df, other.df, self.index)
        a, b = F.col("left").try_cast("double"), F.col("right").try_cast("double")
        near = F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)), F.lit(False))
        return cells.where(~near).isEmpty()

    def __repr__(self) -> str:
        return f"Frame(index={self.index}, columns={self.columns}, order={self.order}, keys={self.keys})"


class Grouped:
    """Rows of a frame by key columns; results are sorted by key."""

    def __init__(self, frame: Frame, by: list[str]):
        self.frame, self.by = frame, by

    def _values(self) -> list[str]:
        return [c for c in self.frame.df.columns if c not in self.by and c not in self.frame.index and c not in self.frame.order]

    def agg(self, *names: str, columns: list[str] | None = None, **options: Any) -> DataFrame:
        options = {"ddof": 1, **options}
        return aggregate.agg_columns(self.frame.df, list(names), columns or self._values(), self.by, self.frame.order, **options).orderBy(*self.by)

    def ohlc(self, column: str) -> DataFrame:
        at = aggregate.order_key(self.frame.df, self.frame.order)
        c = F.col(column)
        return self.frame.df.groupBy(*self.by).agg(F.min_by(c, at).alias("open"), F.max(c).alias("high"), F.min(c).alias("low"), F.max_by(c, at).alias("close"), F.sum(c).alias("volume"))

    def mode(self, column: str, n: int = 1) -> DataFrame:
        return aggregate.mode(self.frame.df, column, self.by, n)

    def quantile(self, column: str, q: float = 0.5, interpolation: str = "linear") -> DataFrame:
        return aggregate.quantiles(self.frame.df, column, q, self.by, interpolation)

    def groups(self) -> DataFrame:
        """A row for each row of the frame: its key, the key's place by first appearance (group) and the row's place (pos)."""
        order = self.frame.order
        rows = with_position(self.frame.df.select(*dict.fromkeys([*self.by, *order])), order, "pos")
        first = rows.groupBy(*self.by).agg(F.min("pos").alias("__first"))
        places = with_position(first, ["__first"], "group").select(*[F.col(c).alias(f"__k_{c}") for c in self.by], "group")
        same = F.lit(True)
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        return rows.join(places, same).select(*self.by, "group", "pos")

    def apply(self, f: Callable, schema: str, shape: str = "frame", group_keys: bool = True) -> DataFrame:
        """A Python function on each group as a pandas frame in the frame's order; a group must fit one task.

        shape says what f returns: a frame with the schema's columns; or, with a schema of the result alone (no keys), a
        scalar, a row (a dict of the columns), a series of values with the rows' order (its place in the group becomes
        `pos`) or rows, a frame. The keys are put in front of all but `frame`, unless group_keys is off.
        """
        order, by = self.frame.order, self.by
        ship(self.frame.df.sparkSession)
        if shape == "frame":

            def whole(pdf):
                return f(pdf.sort_values(order, kind="stable") if order else pdf)

            return self.frame.df.groupBy(*by).applyInPandas(whole, schema)
        if shape not in ("scalar", "row", "series", "rows"):
            raise ValueError(f"unknown shape {shape!r}")
        fields = StructType.fromDDL(schema)
        kept = [self.frame.df.schema[c] for c in by] if group_keys else []
        place = StructType.fromDDL("pos bigint").fields if shape == "series" else []
        names = [x.name for x in [*kept, *place, *fields]]

        def run(key, pdf):
            got = f(pdf.sort_values(order, kind="stable") if order else pdf)
            if shape == "scalar":
                out = pd.DataFrame({fields.names[0]: pd.Series([got], dtype=object)})
            elif shape == "row":
                out = pd.DataFrame([got], columns=fields.names)
            elif shape == "series":
                out = pd.DataFrame({"pos": range(len(got)), fields.names[0]: list(got)})
            else:
                out = got.reset_index(drop=True)
            for c, k in zip(by, key, strict=True):
                if group_keys:
                    out[c] = pd.Series([k] * len(out), index=out.index, dtype=pdf[c].dtype)
            return out[names]

        return self.frame.df.groupBy(*by).applyInPandas(run, StructType([*kept, *place, *fields]))

    def rollup(self, *names: str, columns: list[str] | None = None) -> DataFrame:
        cols = [aggregate.down(n, F.col(v)).alias(f"{v}_{n}") for v in columns or self._values() for n in names]
        return self.frame.df.rollup(*self.by).agg(*cols)

    def cube(self, *names: str, columns: list[str] | None = None) -> DataFrame:
        cols = [aggregate.down(n, F.col(v)).alias(f"{v}_{n}") for v in columns or self._values() for n in names]
        return self.frame.df.cube(*self.by).agg(*cols)
