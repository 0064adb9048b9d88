"""Global row positions and un-keyed windows without a single-task window.

Rows are range-partitioned by their order and written once; each partition numbers its rows, and the partitions'
counts (one row for each) give the offsets. Windows over all rows run on blocks of positions: a block gets copies
of the rows that its frames reach in its neighbours, so every block is complete and none holds more than its size
and the frame. Running aggregates add, to a block's own, the aggregate of all blocks before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..storage import stored

BLOCK = 100_000
CALLED = 10_000


def with_position(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """df with a gapless position from 0 in `order`; ties take any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    out = ranged.withColumn(name, local).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__part", "__before")


def over_blocks(df: DataFrame, pos: str, before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], block: int = BLOCK, called: bool = False) -> DataFrame:
    """Columns from frames that reach at most `before` rows back and `after` rows ahead in a gapless position.

    make gets the window (partitioned and ordered, without a frame) and returns the new columns by name. With `called`,
    a Python function follows: small blocks over all shuffle partitions, as time goes by rows there and not by bytes.
    """
    block = CALLED if called else block
    block = max(block, before, after, 1)
    own = F.floor(F.col(pos) / block)
    at = F.pmod(F.col(pos), F.lit(block))
    copies = F.array_compact(F.array(own, F.when(at >= block - before, own + 1) if before else F.lit(None).cast("long"), F.when(at < after, own - 1) if after else F.lit(None).cast("long")))
    spread = df.withColumn("__own", own).withColumn("__block", F.explode(copies))
    if called:  # a count of one's own is not merged by size
        spread = spread.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__block")
    cols = make(Window.partitionBy("__block").orderBy(pos))
    return spread.withColumns(cols).where("__own = __block").drop("__own", "__block")


def running(df: DataFrame, pos: str, aggs: dict[str, tuple[Column, Callable[[Column], Column], Callable[[Column, Column], Column]]], block: int = BLOCK) -> DataFrame:
    """Running aggregates over all rows in a gapless position.

    aggs: name -> (value, aggregate, combine), e.g. (col("x"), F.sum, lambda a, b: a + b). Null values are skipped.
    """
    tagged = df.withColumn("__block", F.floor(F.col(pos) / block))
    sums = tagged.groupBy("__block").agg(*[f(v).alias(f"__t_{k}") for k, (v, f, _) in aggs.items()])
    past = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    prior = sums.select("__block", *[f(F.col(f"__t_{k}")).over(past).alias(f"__p_{k}") for k, (_, f, _) in aggs.items()])
    w = Window.partitionBy("__block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.join(F.broadcast(prior), "__block")
    cols = {}
    for k, (v, f, combine) in aggs.items():
        here, old = f(v).over(w), F.col(f"__p_{k}")
        cols[k] = F.when(old.isNull(), here).when(here.isNull(), old).otherwise(combine(old, here))
    return out.withColumns(cols).drop("__block", *[f"__p_{k}" for k in aggs])


def filled(df: DataFrame, pos: str, cols: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """df with, for each name, the column's last value that is not null at or before each row of a gapless position."""
    aggs = {f"__f_{k}": (F.when(c.isNotNull(), F.struct(F.col(pos).alias("at"), c.alias("v"))), F.max, lambda old, here: here) for k, c in cols.items()}
    out = running(df, pos, aggs, block)
    return out.withColumns({k: F.col(f"__f_{k}")["v"] for k in cols}).drop(*aggs)
