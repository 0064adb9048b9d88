"""SQL text over one table named `self`."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def _operand(text: str, end: int) -> int:
    """Where the operand that ends at `end` begins: a name, a call, a quoted name or a bracket."""
    k, depth = end, 0
    while k > 0:
        ch = text[k - 1]
        if ch in ")]":
            depth += 1
        elif ch in "([":
            if depth == 0:
                break
            depth -= 1
        elif depth == 0 and not (ch.isalnum() or ch in "_.`"):
            break
        k -= 1
    return k


def _split(sql: str) -> list[str]:
    """Code and string literals in turn: literals are the odd parts."""
    return re.split(r"('(?:[^']|'')*')", sql)


def zoned(df: DataFrame, sql: str) -> str:
    """`x AT TIME ZONE z` and `EXTRACT(TIMEZONE FROM x)` in Spark's functions.

    An instant becomes the wall time of the zone, a wall time (by its type, which is looked up in the table) an instant.
    EXTRACT gives the seconds that the session's zone is ahead of UTC.
    """
    parts = _split(sql)
    marks = [f"\x00{k}\x00" if k % 2 else p for k, p in enumerate(parts)]
    text = "".join(marks)
    extract = re.compile(r"\bEXTRACT\s*\(\s*TIMEZONE\s+FROM\s+", re.IGNORECASE)
    while found := extract.search(text):
        depth, end = 1, found.end()
        while depth and end < len(text):
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        wall = f"CAST({text[found.end() : end - 1]} AS TIMESTAMP_NTZ)"
        text = f"{text[: found.start()]}timestampdiff(SECOND, convert_timezone(current_timezone(), 'UTC', {wall}), {wall}){text[end:]}"
    at = re.compile(r"\s+AT\s+TIME\s+ZONE\s+(\x00\d+\x00|[\w.`]+)", re.IGNORECASE)
    back = lambda t: re.sub(r"\x00(\d+)\x00", lambda m: parts[int(m[1])], t)
    while found := at.search(text):
        begin = _operand(text, found.start())
        operand, zone = text[begin : found.start()], found[1]
        try:
            wall_time = df.selectExpr(back(operand)).schema[0].dataType.typeName() == "timestamp_ntz"
        except AnalysisException:  # a name of an inner query
            wall_time = False
        if wall_time:
            made = f"CAST(convert_timezone({zone}, current_timezone(), {operand}) AS TIMESTAMP)"
        else:
            made = f"convert_timezone(current_timezone(), {zone}, CAST({operand} AS TIMESTAMP_NTZ))"
        text = text[:begin] + made + text[found.end() :]
    return back(text)


def query(df: DataFrame, sql: str) -> DataFrame:
    """Run SQL that reads the table as `self`; decimals in the result become doubles.

    The table is bound to the statement alone, so threads don't collide. Invalid SQL raises when it is analysed.
    """
    sql = zoned(df, sql)
    rest = re.sub(r"^\s*with\s+(?!recursive\b)", "", sql, count=1, flags=re.IGNORECASE)
    glue = ", " if rest != sql else " "
    text = rest.replace("{", "{{").replace("}", "}}")
    out = df.sparkSession.sql("WITH self AS (SELECT * FROM {frame})" + glue + text, frame=df)
    return out.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`") for f in out.schema.fields])
