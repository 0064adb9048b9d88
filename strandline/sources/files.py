"""CSV, JSON, Parquet and Arrow IPC in and out. Paths may be on any file system Spark knows (s3a:// among them).

Readers and writers take tables; `indexed` makes a frame of what was read and `with_index` a table of a frame to write.
Spark opens and closes the file systems itself, so nothing has to be set up or torn down.
"""

from __future__ import annotations

import io
import warnings
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..frame import Frame

COMPRESSIONS = ("none", "snappy", "gzip", "zstd", "lz4", "brotli")


def _columns(df: DataFrame, columns: list[str] | list[int] | None) -> DataFrame:
    if columns is None:
        return df
    return df.select(*[df.columns[c] if isinstance(c, int) else c for c in columns])


def indexed(df: DataFrame, index_column: str) -> Frame:
    """A frame with the named column as its index; without such a column a warning and a frame without index."""
    if index_column not in df.columns:
        warnings.warn(f"no column {index_column!r} to be the index", stacklevel=2)
        return Frame(df)
    return Frame(df.select(index_column, *[c for c in df.columns if c != index_column]), index_column)


def with_index(frame: Frame, include_index: bool = True, index_label: str | None = None) -> DataFrame:
    """A frame's table to write: its index first, under index_label (or its own name), or left out."""
    if not include_index:
        return frame.df.select(*frame.columns)
    label = index_label if len(frame.index) == 1 and index_label else None
    return frame.df.select(*[F.col(c).alias(label or c) for c in frame.index], *frame.columns)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | list[int] | None = None) -> DataFrame:
    """Columns by name or position; only those are read."""
    return _columns(spark.read.parquet(path), columns)


def write_parquet(df: DataFrame, path: str, compression: str = "gzip", include: list[str] | None = None, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression {compression!r}")
    out = df.select(*include) if include else df
    out.write.mode(mode).option("compression", compression).parquet(path, partitionBy=partition_by)


def _csv(reader, delimiter: str, header: bool, schema: StructType | str | None):
    reader = reader.option("sep", delimiter).option("header", header).option("escape", '"')
    return reader.schema(schema) if schema is not None else reader.option("inferSchema", True)


def _named(df: DataFrame, header: bool, columns: list[str] | None, dtype: dict[str, str] | None) -> DataFrame:
    if not header and all(c.startswith("_c") for c in df.columns):
        df = df.toDF(*[f"f{k}" for k in range(len(df.columns))])
    df = _columns(df, columns)
    return df.withColumns({c: df[c].cast(t) for c, t in (dtype or {}).items()})


def read_csv(spark: SparkSession, content: str, delimiter: str = ",", header: bool = True, columns: list[str] | None = None, dtype: dict[str, str] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """CSV from a string held by the driver. Without a header the columns are f0, f1, ..."""
    import pandas as pd

    pdf = pd.read_csv(io.StringIO(content), sep=delimiter, header=0 if header else None)
    if not header:
        pdf.columns = [f"f{k}" for k in range(len(pdf.columns))]
    df = spark.createDataFrame(pdf, schema=schema) if schema is not None else spark.createDataFrame(pdf)
    return _named(df, True, columns, dtype)


def read_csv_file(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, columns: list[str] | None = None, dtype: dict[str, str] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Give a schema for large files: without one they are read twice."""
    return _named(_csv(spark.read, delimiter, header, schema).csv(path), header, columns, dtype)


def write_csv_file(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, include: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A folder of part files."""
    (df.select(*include) if include else df).write.mode(mode).option("sep", delimiter).option("header", header).csv(path)


def write_csv(df: DataFrame, delimiter: str = ",", header: bool = True, include: list[str] | None = None) -> str:
    """CSV as a string on the driver, for small tables."""
    return (df.select(*include) if include else df).toPandas().to_csv(index=False, sep=delimiter, header=header)


def read_json_file(spark: SparkSession, path: str, schema: StructType | str | None = None, multiline: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json(spark: SparkSession, content: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines from a string held by the driver."""
    import pandas as pd

    pdf = pd.read_json(io.StringIO(content), lines=True)
    return spark.createDataFrame(pdf, schema=schema) if schema is not None else spark.createDataFrame(pdf)


def to_ipc(df: DataFrame, metadata: dict[str, str] | None = None) -> bytes:
    """Arrow IPC stream of a table small enough for the driver."""
    import pyarrow as pa

    table = df.toArrow()
    table = table.replace_schema_metadata({**(table.schema.metadata or {}), **(metadata or {})})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, data: bytes) -> tuple[DataFrame, dict[str, str]]:
    """The table and its metadata."""
    import pyarrow as pa

    table = pa.ipc.open_stream(data).read_all()
    meta = {k.decode(): v.decode() for k, v in (table.schema.metadata or {}).items()}
    return spark.createDataFrame(table), meta


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow IPC file on the driver's disk."""
    import pyarrow as pa

    table = df.toArrow()
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)


def read_arrow(spark: SparkSession, path: str, columns: list[str] | list[int] | None = None) -> DataFrame:
    import pyarrow as pa

    with pa.memory_map(path) as f:
        return _columns(spark.createDataFrame(pa.ipc.open_file(f).read_all()), columns)


def to_text(df: DataFrame, rows: int = 20) -> str:
    return df.limit(rows).toPandas().to_string()


def s3_settings(key: str | None = None, secret: str | None = None, endpoint: str | None = None, timeout_ms: int = 30_000, connect_ms: int = 10_000) -> dict[str, Any]:
    """Settings for s3a:// paths; without a key the default credential chain serves."""
    base = "spark.hadoop.fs.s3a."
    out = {f"{base}connection.timeout": timeout_ms, f"{base}connection.establish.timeout": connect_ms, f"{base}endpoint": endpoint, f"{base}access.key": key, f"{base}secret.key": secret}
    return {k: v for k, v in out.items() if v is not None}


