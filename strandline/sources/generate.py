"""Tables made from nothing: ranges, dates, random numbers, rows given by value."""

from __future__ import annotations

import datetime as dt
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.offsets import Offset, Tick, parse
from ..functions.temporal import from_micros, tz_localize

EPOCH = dt.datetime(1970, 1, 1)


def _clean(v: Any) -> Any:
    return None if isinstance(v, float) and math.isnan(v) else v


def from_rows(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """NaN becomes null, as the constructors of the frame have it."""
    return spark.createDataFrame([tuple(_clean(v) for v in r) for r in rows], schema)


def from_columns(spark: SparkSession, columns: dict[str, list], index: list | None = None, name: str = "index") -> DataFrame:
    """Columns by name beside an index (0, 1, ... by default)."""
    n = len(next(iter(columns.values()), []))
    labels = list(range(n)) if index is None else index
    if len(labels) != n or any(len(c) != n for c in columns.values()):
        raise ValueError("columns and index differ in length")
    rows = [tuple(_clean(v) for v in r) for r in zip(labels, *columns.values(), strict=True)]
    return spark.createDataFrame(rows, [name, *columns])


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def null_table(spark: SparkSession, schema: StructType, n: int) -> DataFrame:
    return spark.range(n).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def from_range(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "index") -> DataFrame:
    return spark.range(start, stop, step).toDF(name)


def date_range(spark: SparkSession, start: dt.datetime, end: dt.datetime | None = None, periods: int | None = None, offset: str | Offset = "D", tz: str | None = None, ambiguous: str = "raise", nonexistent: str = "raise", name: str = "index") -> DataFrame:
    """Naive times (instants, with a zone) from start: up to end, or so many. Fixed spans are generated on the executors."""
    rule = parse(offset)
    if (end is None) == (periods is None):
        raise ValueError("give end or periods")
    if isinstance(rule, Tick):
        span, at = rule.n * rule.span, (start - EPOCH) // dt.timedelta(microseconds=1)
        n = periods if periods is not None else max(0, ((end - start) // dt.timedelta(microseconds=1)) // span + 1)
        out = spark.range(n).select(from_micros(F.lit(at) + F.col("id") * F.lit(span)).alias(name))
    else:
        out = spark.createDataFrame([(t,) for t in rule.range(start, end, periods)], f"{name} timestamp_ntz")
    return out.select(tz_localize(F.col(name), tz, ambiguous, nonexistent).alias(name)) if tz else out


def random(spark: SparkSession, n: int, seed: int = 0, normal: bool = False, name: str = "value") -> DataFrame:
    return spark.range(n).select("id", (F.randn(seed) if normal else F.rand(seed)).alias(name))
