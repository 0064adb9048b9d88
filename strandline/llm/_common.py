"""Shared helpers: reading tables, the shared scratch folder, shipping the package to Python workers."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_PARENT = str(Path(__file__).resolve().parents[2])
LOCAL_CHECKPOINTS = "/tmp/checkpoints/strandline"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (a cluster may also use --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if PACKAGE_PARENT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_PARENT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Unset, a local one serves where all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or LOCAL_CHECKPOINTS).rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, so a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or scratch(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later result reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Folder:
    """A scratch folder for the steps of one operator, deleted when its result no longer reads them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.steps = spark, scratch(spark, tag), 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        return stored(df, "", f"{self.path}/{self.steps}")

    def drop(self) -> None:
        discard(self.spark, self.path)


def release() -> None:
    """Give memory that is free, but still held by Arrow's pool and by malloc, back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc has it
        libc.malloc_trim(0)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose workers, which outlive their tasks, keep no memory of them."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(released, schema)


FEW = 500_000


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """Narrow stored rows, marked for a broadcast if they are at most `most`, else left to a shuffled join."""
    return F.broadcast(rows) if rows.count() <= most else rows


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the rows whose labels are never learnt from: crc32(doc_id as text) mod 4 is 2. A null id is not held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def vocabulary_path(name: str) -> str:
    """Where the installed public tokenizer files keep `name`."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
