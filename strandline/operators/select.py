"""Row selection, order, duplicates and positional edits on tables with an explicit order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .position import with_position


def sort_values(df: DataFrame, by: list[str], ascending: bool = True, nulls_last: bool = True, tie: list[str] | None = None) -> DataFrame:
    """One direction for all keys; `tie` columns (ascending) make the order total."""
    pick = {(True, True): F.asc_nulls_last, (True, False): F.asc_nulls_first, (False, True): F.desc_nulls_last, (False, False): F.desc_nulls_first}[ascending, nulls_last]
    return df.orderBy(*[pick(c) for c in by], *[F.asc(c) for c in tie or []])


def n_largest(df: DataFrame, column: str, n: int, tie: list[str] | None = None) -> DataFrame:
    """Top n by a bounded heap in each task, without a full sort."""
    return sort_values(df, [column], ascending=False, tie=tie).limit(n)


def n_smallest(df: DataFrame, column: str, n: int, tie: list[str] | None = None) -> DataFrame:
    return sort_values(df, [column], tie=tie).limit(n)


def head(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[F.desc_nulls_first(c) for c in order]).limit(n).orderBy(*order)


def iloc(df: DataFrame, order: list[str], start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Python's slice over the rows in order; a negative step reverses them."""
    rows = with_position(df, order, "__pos")
    if start is not None and start < 0 or stop is not None and stop < 0 or step < 0:
        n = rows.count()
        ids = range(n)[slice(start, stop, step)]
    else:
        ids = None
    if ids is None:
        a = start or 0
        rows = rows.where((F.col("__pos") >= a) & ((F.col("__pos") - a) % step == 0))
        rows = rows if stop is None else rows.where(F.col("__pos") < stop)
        return rows.orderBy("__pos").drop("__pos")
    if not len(ids):
        return rows.limit(0).drop("__pos")
    low, high = min(ids[0], ids[-1]), max(ids[0], ids[-1])
    rows = rows.where(F.col("__pos").between(low, high) & (F.pmod(F.col("__pos") - ids[0], F.lit(abs(step))) == 0))
    return rows.orderBy(F.asc("__pos") if step > 0 else F.desc("__pos")).drop("__pos")


def take(df: DataFrame, order: list[str], positions: list[int]) -> DataFrame:
    """Rows at positions, repeats and order kept; negative ones count from the end."""
    rows = with_position(df, order, "__pos")
    n = rows.count() if any(p < 0 for p in positions) else 0
    spark = df.sparkSession
    asked = spark.createDataFrame([(k, p if p >= 0 else p + n) for k, p in enumerate(positions)], "__k long, __pos long")
    return rows.join(F.broadcast(asked), "__pos").orderBy("__k").drop("__k", "__pos")


def loc(df: DataFrame, index: str, label: Any) -> DataFrame:
    return df.where(F.col(index) == F.lit(label))


def loc_slice(df: DataFrame, index: str, low: Any = None, high: Any = None) -> DataFrame:
    """Labels from low to high, both in."""
    out = df if low is None else df.where(F.col(index) >= F.lit(low))
    return out if high is None else out.where(F.col(index) <= F.lit(high))


def loc_labels(df: DataFrame, index: str, labels: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of the labels of another table, as often as they occur there."""
    out = labels.select(F.col(labels.columns[0]).alias("__label"), *([order] if order else [])).join(df, F.col("__label") == F.col(index)).drop("__label")
    return out.orderBy(order).drop(order) if order else out


def drop_labels(df: DataFrame, index: str, labels: DataFrame) -> DataFrame:
    return df.join(labels.select(F.col(labels.columns[0]).alias("__label")), F.col(index).eqNullSafe(F.col("__label")), "left_anti")


def drop_duplicates(df: DataFrame, subset: list[str], order: list[str], keep: str | bool = "first") -> DataFrame:
    """Rows unique in subset: the first or last in order of each, or (False) only those that occur once."""
    w = Window.partitionBy(*subset)
    if keep is False:
        return df.withColumn("__n", F.count("*").over(w)).where("__n = 1").drop("__n")
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first', 'last' or False")
    by = order if keep == "first" else [F.desc_nulls_first(c) for c in order]
    return df.withColumn("__n", F.row_number().over(w.orderBy(*by))).where("__n = 1").drop("__n")


def unique(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Distinct values in first-seen order."""
    return df.groupBy(column).agg(F.min(F.struct(*order)).alias("__first")).orderBy("__first").select(column)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def dictionary_encode(df: DataFrame, column: str, order: list[str], name: str = "code") -> DataFrame:
    """df with codes from 0 by first appearance; null stays null."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("__first"))
    codes = with_position(firsts, ["__first"], name).select(F.col(column).alias("__value"), name)
    return df.join(codes, F.col(column) == F.col("__value"), "left").drop("__value")


def drop_null(df: DataFrame, how: str = "any", thresh: int | None = None, subset: list[str] | None = None) -> DataFrame:
    if thresh is not None and how == "all":
        raise ValueError("how='all' and thresh exclude each other")
    return df.dropna(how=how, thresh=thresh, subset=subset)


def drop_null_columns(df: DataFrame, how: str = "any", thresh: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns with nulls dropped (any, all, or with fewer than thresh values), after one counting pass."""
    if thresh is not None and how == "all":
        raise ValueError("how='all' and thresh exclude each other")
    names = [c for c in df.columns if c not in (keep or [])]
    got = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in names]).first()
    least = thresh if thresh is not None else got["__n"] if how == "any" else min(1, got["__n"])
    return df.select(*[c for c in df.columns if c not in names or got[c] >= least])


def fill_null(df: DataFrame, value: Any, subset: list[str] | None = None) -> DataFrame:
    return df.select(*[F.coalesce(c, F.lit(value)).alias(c) if c in (subset or df.columns) else F.col(c) for c in df.columns])


def index_of(df: DataFrame, column: str, value: Any, order: list[str]) -> DataFrame:
    """Position of the first row with the value, in one row; null if there is none."""
    rows = with_position(df, order, "__pos")
    return rows.agg(F.min(F.when(F.col(column).eqNullSafe(F.lit(value)), F.col("__pos"))).alias("index"))


def searchsorted(df: DataFrame, column: str, value: Any, side: str = "left") -> DataFrame:
    """Where the value would go into the sorted column: the number of smaller (or, right, not larger) ones."""
    c = F.col(column)
    return df.agg(F.count_if(c < F.lit(value) if side == "left" else c <= F.lit(value)).alias("position"))


def insert_row(df: DataFrame, order: list[str], position: int, values: dict[str, Any]) -> DataFrame:
    """A row put in at a position."""
    rows = with_position(df, order, "__pos").withColumn("__pos", F.when(F.col("__pos") >= position, F.col("__pos") + 1).otherwise(F.col("__pos")))
    new = df.sparkSession.createDataFrame([tuple(values.get(c) for c in df.columns)], df.schema).withColumn("__pos", F.lit(position).cast("long"))
    return rows.unionByName(new).orderBy("__pos").drop("__pos")


def delete_row(df: DataFrame, order: list[str], position: int) -> DataFrame:
    return with_position(df, order, "__pos").where(F.col("__pos") != position).orderBy("__pos").drop("__pos")


def indices_nonzero(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    return with_position(df, order, "position").where(F.col(column).cast("double") != 0).select("position")


def nth_smallest(df: DataFrame, column: str, n: int, order: list[str]) -> DataFrame:
    """The row at place n (from 0) when sorted by the column, ties in order: what a partition around it would put there."""
    return take(df, [column, *[c for c in order if c != column]], [n])


def monotonic(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row: whether the column never falls, and never rises, in order."""
    from .position import over_blocks

    rows = over_blocks(with_position(df.select(column, *[c for c in order if c != column]), order, "__pos"), "__pos", 1, 0, lambda w: {"__prev": F.lag(column).over(w)})
    d: Column = F.col(column) >= F.col("__prev")
    u: Column = F.col(column) <= F.col("__prev")
    return rows.agg(F.coalesce(F.bool_and(d), F.lit(True)).alias("increasing"), F.coalesce(F.bool_and(u), F.lit(True)).alias("decreasing"))
