"""Steps whose time must not grow faster than the input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from strandline.frame import Frame
from strandline.plans.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_bfill_by_key_reads_each_row_once(spark, sf):
    df = spark.range(40_000).select("id", (F.col("id") % 2).alias("k"), F.when(F.col("id") % 1000 < 2, F.col("id")).alias("v"))
    f = Frame(df, "id", keys="k").bfill().df
    assert "unboundedfollowing" not in plan(f) and "unboundedfollowing" not in plan(QUERIES["bfill"](spark, sf))
    got = {r.id: r.v for r in f.collect()}
    assert got == {k: k if k % 1000 < 2 else None if k >= 39_002 else (k // 1000 + 1) * 1000 + k % 2 for k in range(40_000)}


def test_bfill_by_key_with_null_labels(spark):
    df = spark.createDataFrame([("a", None, None), ("a", 1, 5), ("a", 2, None), (None, 1, None), (None, 2, 7), (None, None, 9)], "k string, i int, v int")
    got = {(r.k, r.i): r.v for r in Frame(df, "i", keys="k").bfill().df.collect()}
    assert got == {("a", None): 5, ("a", 1): 5, ("a", 2): None, (None, None): 9, (None, 1): 7, (None, 2): 7}


def test_windows_are_cut_from_joined_arrays(spark):
    def shared(p):
        a = p["v"].to_numpy()
        while a.base is not None:
            a = a.base
        return {"n": a.size}

    for keys in ((), "k"):
        df = spark.range(1000).select("id", (F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
        got = Frame(df, "id", keys=keys).rolling_apply_frame(shared, ["v"], 4, "n long", min_periods=1).df.select("applied.n").collect()
        assert len(got) == 1000 and min(r.n for r in got) > 4


@pytest.mark.parametrize("columns", [["d"], ["i", "l"], ["b"], ["d", "i", "b", "g"], ["d", "s"], ["t", "d"], ["d2"], ["i2", "d"], ["b2"]])
@pytest.mark.parametrize(("keys", "options"), [((), {"min_periods": 1}), ("k", {"min_periods": 2, "center": True, "closed": "both"})])
def test_windows_frames_are_as_of_rows(spark, columns, keys, options):
    """Values and types as of pd.DataFrame over the window's rows as dicts, nulls or not, and free to be changed."""
    n, size = 60, 3
    k = F.col("id")
    gap = lambda c: F.when(~k.between(20, 25) & (k % 7 != 3), c)
    cols = {"d": k / 3, "g": (k / 3).cast("float"), "i": k.cast("int"), "l": k + 2**60, "b": k % 3 == 0, "s": k.cast("string"), "t": F.timestamp_seconds(k)}
    df = spark.range(n).select("id", (k % 2).alias("k"), *[c.alias(x) for x, c in cols.items()], *[gap(cols[c]).alias(f"{c}2") for c in "dib"])

    def told(p):
        out = f"{p.to_dict('split')} {p.dtypes.to_dict()} {p.index}"
        p[p.columns[0]] = 0
        p["more"] = 1
        p.iloc[0, 0] = 7
        return {"out": out}

    got = Frame(df, "id", keys=keys).rolling_apply_frame(told, columns, size, "out string", **options).df.collect()
    rows = {key: [r.asDict() for r in df.orderBy("id").collect() if not keys or r.k == key] for key in ((0, 1) if keys else (None,))}
    want = {}
    for part in rows.values():
        for at, r in enumerate(part):
            first, last = (at - size + 1, at) if not keys else (at - size + 1, at + 1)
            held = [{c: x[c] for c in columns} for x in part[max(0, first) : last + 1]]
            want[r["id"]] = told(pd.DataFrame(held, columns=columns))["out"] if len(held) >= options["min_periods"] else None
    assert {r.id: r.applied and r.applied.out for r in got} == want


def test_rolling_apply_frame_query_skips_gaps(spark, tmp_path):
    rows = [(k, None if k in (3, 4, 5, 6, 9) else float(k * k % 11)) for k in range(12)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.span, r.n) for r in QUERIES["rolling_apply_frame"](spark, str(tmp_path)).collect()}
    value = [np.nan if v is None else v for _, v in rows]
    want = {}
    for k in range(12):
        v = [x for x in value[max(0, k - 3) : k + 1] if x == x]
        want[k] = (max(v) - min(v) if v else None, min(k, 3) + 1)
    assert got == want
