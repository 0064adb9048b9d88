"""Alignment by index, concatenation, set operations on labels, key joins and as-of joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .position import filled, with_position


def align(left: DataFrame, right: DataFrame, index: list[str], suffixes: tuple[str, str] = ("__l", "__r")) -> DataFrame:
    """Full outer join on the index: index columns once, then every other column of either side with its suffix."""
    a = left.select(*index, *[F.col(c).alias(c + suffixes[0]) for c in left.columns if c not in index])
    b = right.select(*index, *[F.col(c).alias(c + suffixes[1]) for c in right.columns if c not in index])
    return a.join(b, index, "full_outer")


def binary(left: DataFrame, right: DataFrame, index: list[str], op: Callable[[Column, Column], Column]) -> DataFrame:
    """op of the columns of one name on rows of one label; a column or row that one side lacks is null."""
    both = align(left, right, index)
    a, b = [c for c in left.columns if c not in index], [c for c in right.columns if c not in index]
    cols = [op(F.col(f"{c}__l"), F.col(f"{c}__r")).alias(c) if c in b else F.lit(None).cast("double").alias(c) for c in a]
    return both.select(*index, *cols, *[F.lit(None).cast("double").alias(c) for c in b if c not in a])


def binary_series(frame: DataFrame, series: DataFrame, index: list[str], op: Callable[[Column, Column], Column]) -> DataFrame:
    """op of every column of frame with the one value column of series, by row label."""
    value = next(c for c in series.columns if c not in index)
    both = frame.join(series.select(*index, F.col(value).alias("__v")), index, "full_outer")
    return both.select(*index, *[op(F.col(c), F.col("__v")).alias(c) for c in frame.columns if c not in index])


def reindex(df: DataFrame, labels: DataFrame, index: str, fill=None) -> DataFrame:
    """One row for each label, in label order; rows that df lacks, and nulls, take the fill value."""
    names = labels.select(F.col(labels.columns[0]).alias(index))
    out = names.join(df, index, "left")
    if fill is not None:
        out = out.select(index, *[F.coalesce(c, F.lit(fill)).alias(c) for c in df.columns if c != index])
    return out.orderBy(F.asc_nulls_last(index))


def _widest(frames: list[DataFrame], name: str) -> str:
    """A type that holds the order column of every frame: theirs where they agree, else double for numbers and string for the rest."""
    kinds = {f.select(f"__at.{name}").schema[0].dataType for f in frames}
    if len(kinds) == 1:
        return kinds.pop().simpleString()
    return "double" if all(isinstance(k, NumericType) for k in kinds) else "string"


def concat_rows(frames: list[DataFrame], join: str = "outer", sort_columns: bool = True, ignore_index: str | None = None, order: list[str] | None = None) -> DataFrame:
    """All rows, columns matched by name: those of any frame (outer) or of all (inner).

    ignore_index: an index column that is replaced by the row's place, frame after frame, each in `order` (the old index).
    """
    if ignore_index:
        at = order or [ignore_index]
        frames = [f.select(F.struct(F.lit(k).alias("frame"), *at).alias("__at"), *[c for c in f.columns if c != ignore_index]) for k, f in enumerate(frames)]
        keyed = [f.withColumn("__at", F.struct(F.col("__at.frame"), *[F.col(f"__at.{c}").cast(_widest(frames, c)) for c in at])) for f in frames]
        out = with_position(concat_rows(keyed, join, sort_columns), ["__at"], ignore_index).drop("__at")
        return out.select(ignore_index, *[c for c in out.columns if c != ignore_index])
    if not frames:
        raise ValueError("nothing to concatenate")
    if join == "inner":
        shared = set.intersection(*[set(f.columns) for f in frames])
        frames = [f.select(*[c for c in f.columns if c in shared]) for f in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns)) if sort_columns else out


def concat_columns(frames: list[DataFrame], index: list[str], join: str = "outer") -> DataFrame:
    """Columns side by side by label: of all labels (outer) or of those in every frame (inner). Column names must differ."""
    if not frames:
        raise ValueError("nothing to concatenate")
    names = [c for f in frames for c in f.columns if c not in index]
    if len(set(names)) < len(names):
        raise ValueError("frames share column names")
    return reduce(lambda a, b: a.join(b, index, "full_outer" if join == "outer" else "inner"), frames)


def update(df: DataFrame, changes: DataFrame, index: list[str], order: list[str] | None = None) -> DataFrame:
    """Values of `changes` put over those of the same label and column; of a repeated label its last row in `order`."""
    new = [c for c in changes.columns if c not in index]
    at = F.struct(*(order or []), F.monotonically_increasing_id())
    last = changes.select(*index, F.struct(*new).alias("__new"), at.alias("__at")).groupBy(*index).agg(F.max_by("__new", "__at").alias("__new"))
    other = last.select(*index, F.lit(True).alias("__hit"), *[F.col("__new")[c].alias(f"__n_{c}") for c in new])
    both = df.join(other, index, "left")
    return both.select(*[F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def label_union(a: DataFrame, b: DataFrame, index: str, order: list[str] | None = None) -> DataFrame:
    """Labels of either, each once. With order columns (of both), the first seen come first: a's in order, then b's others."""
    if order is None:
        return a.select(index).unionByName(b.select(index)).distinct()
    rows = [f.select(index, F.struct(F.lit(k).alias("side"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("__at")) for k, f in enumerate((a, b))]
    return rows[0].unionByName(rows[1]).groupBy(index).agg(F.min("__at").alias("__at")).orderBy("__at").select(index)


def label_intersection(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Labels of a that b has, repeats kept; null is a label."""
    return _labels(a, b, index, "left_semi")


def label_difference(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    return _labels(a, b, index, "left_anti")


def _labels(a: DataFrame, b: DataFrame, index: str, how: str) -> DataFrame:
    other = b.select(F.col(index).alias("__other")).distinct()
    return a.select(index).join(other, F.col(index).eqNullSafe(F.col("__other")), how)


def label_symmetric_difference(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    return label_difference(a, b, index).unionByName(label_difference(b, a, index))


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Key join of any kind Spark has; Catalyst and AQE choose how it runs."""
    return left.crossJoin(right) if how == "cross" else left.join(right, on, how)


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], value: list[str], tie: list[str] | None = None) -> DataFrame:
    """left with the last right values at or before each time, by key: one union and one window, no range join.

    Without keys the union is put in order once and the last values run over its blocks.
    """
    values = F.struct(*[F.col(c) for c in value])
    r = right.select(*by, on, values.alias("__v"), F.lit(0).alias("__side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*by, on)])
    lft = left.select(*by, on, F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__side"), *[c for c in left.columns if c not in (*by, on)])
    both = lft.unionByName(r)
    if by:
        w = Window.partitionBy(*by).orderBy(on, "__side", *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w))
    else:
        out = filled(with_position(both, [on, "__side", *(tie or [])], "__pos"), "__pos", {"__last": F.col("__v")}).drop("__pos")
    out = out.where("__side = 1")
    return out.select(*left.columns, *[F.col("__last")[c].alias(f"{c}_asof" if c in left.columns else c) for c in value])


def diff_frames(a: DataFrame, b: DataFrame, index: list[str]) -> DataFrame:
    """Cells that differ: (index, column, left, right) as strings; a row or column that one side lacks differs."""
    both = align(a.withColumn("__in", F.lit(True)), b.withColumn("__in", F.lit(True)), index)
    names = sorted({*a.columns, *b.columns} - set(index))
    side = lambda c, cols, s: F.col(f"{c}{s}").cast("string") if c in cols else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), side(c, a.columns, "__l").alias("left"), side(c, b.columns, "__r").alias("right")) for c in names])
    missing = F.col("__in__l").isNull() | F.col("__in__r").isNull()
    rows = both.select(*index, missing.alias("__missing"), F.explode(cells).alias("d"))
    return rows.where(F.col("__missing") | ~F.col("d.left").eqNullSafe(F.col("d.right"))).select(*index, "d.*")
