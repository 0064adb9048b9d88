"""Weighted statistics over blocks against a plain recursion, with and without keys and missing values."""

import math
import random

import pytest
from pyspark.sql import functions as F
from strandline.frame import Frame
from strandline.operators import ewm


def plain(rows, d, stat, bias):
    """Weights spelt out row by row: of pairs (x, y) or None."""
    out, kept, step = [], [], 0
    for pair in rows:
        if pair is not None or not d.ignore_na:
            step += 1
        if pair is not None:
            kept.append((step, *pair))
        if len(kept) < max(d.min_periods, 1):
            out.append(None)
            continue
        keep = 1 - d.rate
        if stat == "sum":
            out.append(sum(x * keep ** (step - s) for s, x, _ in kept))
            continue
        if d.adjust:
            w = [keep ** (kept[-1][0] - s) for s, _, _ in kept]
        else:  # each new value takes its share of what the one before has left
            w = [1.0]
            for (a, _, _), (b, _, _) in zip(kept, kept[1:]):
                old = keep ** (b - a)
                w = [v * old / (old + d.rate) for v in w] + [d.rate / (old + d.rate)]
        total = sum(w)
        mean = lambda k: sum(v * r[k] for v, r in zip(w, kept)) / total
        mx, my = mean(1), mean(2)
        if stat == "mean":
            out.append(mx)
            continue
        c = lambda i, j, a, b: sum(v * (r[i] - a) * (r[j] - b) for v, r in zip(w, kept)) / total
        xy, xx, yy = c(1, 2, mx, my), c(1, 1, mx, mx), c(2, 2, my, my)
        if stat == "corr":
            out.append(xy / math.sqrt(xx * yy) if xx * yy > 0 else None)
            continue
        got = xy if stat == "cov" else xx
        if not bias:
            left = 1 - sum(v * v for v in w) / total**2
            got = got / left if left > 1e-12 else None
        out.append(math.sqrt(got) if stat == "std" and got is not None else got)
    return out


LEFT, AGED, VALID, ALL = {"alpha": 0.9}, {"alpha": 0.9, "adjust": False}, {"alpha": 0.6, "ignore_na": True, "min_periods": 3}, {"alpha": 1.0}


@pytest.mark.parametrize(("stat", "holes", "decay"), [("mean", False, LEFT), ("mean", True, AGED), ("sum", True, LEFT), ("var", True, VALID), ("std", True, ALL), ("cov", True, AGED), ("corr", True, AGED)])
def test_blocks(spark, stat, holes, decay):
    rng = random.Random(7)
    d = ewm.Decay(**decay)
    data = []
    for k in (None, "a", "b"):
        for t in range(150):
            gone = holes and (rng.random() < 0.3 or 40 <= t < 75)
            data.append((k, t, math.nan if gone and t % 2 else None if gone else rng.gauss(5, 2), rng.gauss(0, 1)))
    df = spark.createDataFrame(data, "k string, t int, x double, y double")
    expected = {}
    for k in (None, "a", "b"):
        rows = [(t, x, y) for key, t, x, y in data if key == k]
        pairs = [None if x is None or math.isnan(x) else (x, y) for _, x, y in rows]
        expected |= {(k, t): v for (t, _, _), v in zip(rows, plain(pairs, d, stat, False))}
    got = {(r.k, r.t): r.out for r in ewm.ewm(df, "x", ["t"], ["k"], d, stat, "out", "y" if stat in ("cov", "corr") else None, block=50).collect()}
    assert got.keys() == expected.keys()
    for at, v in expected.items():
        assert (v is None) == (got[at] is None), at
        assert v is None or math.isclose(v, got[at], rel_tol=1e-6, abs_tol=1e-7), at


def test_without_keys_and_empty(spark):
    df = spark.range(500).select("id", (F.col("id") % 17).cast("double").alias("x"))
    out = [r.m for r in Frame(df, "id").ewm("x", alpha=0.7, name="m").df.orderBy("id").collect()]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(out, plain([(k % 17, 0) for k in range(500)], ewm.Decay(alpha=0.7), "mean", False), strict=True))
    assert Frame(df.where("id < 0"), "id").ewm("x", alpha=0.7).df.count() == 0
