"""Index: the label column of a frame, with the look-ups and edits of an index object."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import temporal as T
from .operators import combine, select
from .operators.position import with_position


class Index:
    """Labels in a column of df, in the order of `order` (the labels themselves by default). Scalars start a job, the rest is lazy."""

    def __init__(self, df: DataFrame, name: str, order: list[str] | None = None):
        self.df, self.name, self.order = df, name, order or [name]

    def _with(self, df: DataFrame) -> Index:
        return Index(df, self.name, [c for c in self.order if c in df.columns] or None)

    @property
    def labels(self) -> DataFrame:
        return self.df.select(self.name)

    @property
    def dtype(self) -> str:
        return self.df.schema[self.name].dataType.simpleString()

    def size(self) -> int:
        return self.df.count()

    def empty(self) -> bool:
        return self.df.isEmpty()

    def min(self) -> Any:
        return self.df.agg(F.min(self.name)).first()[0]

    def max(self) -> Any:
        return self.df.agg(F.max(self.name)).first()[0]

    def _positions(self) -> DataFrame:
        return with_position(self.df.select(*dict.fromkeys([self.name, *self.order])), self.order, "__pos")

    def argmin(self) -> int | None:
        return self._positions().agg(F.min_by("__pos", F.struct(self.name, "__pos"))).first()[0]

    def argmax(self) -> int | None:
        return self._positions().agg(F.max_by("__pos", F.struct(F.col(self.name), -F.col("__pos")))).first()[0]

    def is_monotonic(self) -> tuple[bool, bool]:
        """Whether labels never fall, and never rise, in order."""
        return tuple(select.monotonic(self.df, self.name, self.order).first())

    def has_duplicates(self) -> bool:
        return not self.df.groupBy(self.name).count().where("count > 1").isEmpty()

    def contains(self, label: Any) -> bool:
        return not self.df.where(F.col(self.name) == F.lit(label)).isEmpty()

    def get_loc(self, label: Any) -> list[int]:
        """All positions of a label."""
        return [r[0] for r in self._positions().where(F.col(self.name) == F.lit(label)).select("__pos").orderBy("__pos").collect()]

    def searchsorted(self, label: Any, side: str = "left") -> int:
        return select.searchsorted(self.df, self.name, label, side).first()[0]

    def slice_locs(self, low: Any = None, high: Any = None) -> tuple[int, int]:
        """Half-open positions of the labels from low to high, both in, of a sorted index."""
        start = 0 if low is None else self.searchsorted(low)
        return start, self.size() if high is None else self.searchsorted(high, "right")

    def loc(self, label: Any) -> Index:
        return self._with(select.loc(self.df, self.name, label))

    def iloc(self, rows: slice) -> Index:
        return self._with(select.iloc(self.df, self.order, rows.start, rows.stop, rows.step or 1))

    def at(self, position: int) -> Any:
        return select.take(self.df, self.order, [position]).first()[self.name]

    def take(self, positions: list[int]) -> DataFrame:
        return select.take(self.df, self.order, positions).select(self.name)

    def isin(self, values: list) -> DataFrame:
        return self.df.withColumn("isin", F.col(self.name).isin(values))

    def filter(self, mask: Column) -> Index:
        return self._with(self.df.where(mask))

    def where(self, mask: Column, other: Any) -> Index:
        return self._with(self.df.withColumn(self.name, F.when(mask, F.col(self.name)).otherwise(F.lit(other))))

    def map(self, f) -> Index:
        """A Column function of the labels."""
        return self._with(self.df.withColumn(self.name, f(F.col(self.name))))

    def drop(self, labels: DataFrame) -> Index:
        return self._with(select.drop_labels(self.df, self.name, labels))

    def delete(self, position: int) -> Index:
        return self._with(select.delete_row(self.df, self.order, position))

    def insert(self, position: int, label: Any) -> DataFrame:
        return select.insert_row(self.labels if self.order == [self.name] else self.df, self.order, position, {self.name: label}).select(self.name)

    def append(self, other: Index) -> DataFrame:
        return self.labels.unionByName(other.labels.withColumnRenamed(other.name, self.name))

    def drop_duplicates(self, keep: str | bool = "first") -> Index:
        return self._with(select.drop_duplicates(self.df, [self.name], self.order, keep))

    def unique(self) -> DataFrame:
        return select.unique(self.df, self.name, self.order)

    def value_counts(self) -> DataFrame:
        return select.value_counts(self.df, self.name)

    def sort_values(self, ascending: bool = True) -> Index:
        return self._with(select.sort_values(self.df, [self.name], ascending))

    def union(self, other: Index) -> DataFrame:
        return combine.label_union(self.labels, other.labels.withColumnRenamed(other.name, self.name), self.name)

    def intersection(self, other: Index) -> DataFrame:
        return combine.label_intersection(self.labels, other.labels.withColumnRenamed(other.name, self.name), self.name)

    def difference(self, other: Index) -> DataFrame:
        return combine.label_difference(self.labels, other.labels.withColumnRenamed(other.name, self.name), self.name)

    def symmetric_difference(self, other: Index) -> DataFrame:
        return combine.label_symmetric_difference(self.labels, other.labels.withColumnRenamed(other.name, self.name), self.name)

    def equals(self, other: Index) -> bool:
        a, b = self.labels, other.labels.withColumnRenamed(other.name, self.name)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def normalize(self) -> Index:
        return self.map(T.normalize)

    def tz_localize(self, tz: str, ambiguous: str = "raise", nonexistent: str = "raise") -> Index:
        return self.map(lambda c: T.tz_localize(c, tz, ambiguous, nonexistent))

    def tz_convert(self, tz: str) -> Index:
        return self.map(lambda c: T.tz_convert(c, tz))

    def local_timestamp(self, tz: str) -> Index:
        return self.map(lambda c: T.local_timestamp(c, tz))

    def day_of_week(self) -> DataFrame:
        return self.df.select(self.name, T.day_of_week(F.col(self.name)).alias("day_of_week"))

    def to_list(self) -> list:
        return [r[0] for r in self.df.orderBy(*self.order).select(self.name).collect()]
