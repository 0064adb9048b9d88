"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints/strandline"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; a cluster may use --py-files instead."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a local folder if all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(at or LOCAL).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str = "table") -> DataFrame:
    """df written once and read back: later steps neither recompute it nor depend on the executors that made it."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
