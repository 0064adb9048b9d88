"""Streaming forms: bars on event time, deduplication within a watermark, weighted means kept for each key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship


def bars(stream: DataFrame, time: str, value: str, span: str, keys: list[str] | None = None, late: str = "10 minutes", order: list[str] | None = None) -> DataFrame:
    """Open, high, low, close and sum by tumbling window from the epoch; rows later than `late` are left out."""
    at = F.struct(time, *(order or []))
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, span), *(keys or []))
    out = grouped.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.sum(value).alias("volume"))
    return out.select(F.col("window.start").alias("bucket"), *(keys or []), "open", "high", "low", "close", "volume")


def deduplicated(stream: DataFrame, time: str, subset: list[str], late: str = "10 minutes") -> DataFrame:
    """First arrivals; a repeat is caught within the watermark's delay, which bounds the state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(subset)


def ewm_mean(stream: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """(key, order, value, ewm_mean) of each arriving row: the adjusted weighted mean, its state kept for each key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(stream.sparkSession)
    types = [stream.schema[c].dataType.simpleString() for c in (key, order)]
    schema = f"{key} {types[0]}, {order} {types[1]}, {value} double, ewm_mean double"

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, weight = state.get if state.exists else (0.0, 0.0)
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for x in pdf[value]:
            weight = weight * (1 - alpha) + 1
            mean += (float(x) - mean) / weight
            out.append(mean)
        state.update((mean, weight))
        yield pd.DataFrame({key: group[0], order: pdf[order].to_numpy(), value: pdf[value].astype(float).to_numpy(), "ewm_mean": out})

    return stream.where(F.col(value).isNotNull()).groupBy(key).applyInPandasWithState(run, schema, "mean double, weight double", "append", GroupStateTimeout.NoTimeout)
