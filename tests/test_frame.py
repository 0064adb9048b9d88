"""The indexed frame on small tables with known results."""

import datetime as dt
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from strandline.frame import Frame
from strandline.functions import math as M
from strandline.operators import aggregate, combine, ewm, select
from strandline.operators.position import with_position
from strandline.plans.queries import QUERIES
from strandline.sources import files, generate


def column(frame, name, by="index"):
    df = frame.df if isinstance(frame, Frame) else frame
    return [r[name] for r in df.orderBy(by).collect()]


def near(a, b):
    return len(a) == len(b) and all((x is None and y is None) or (x is not None and y is not None and math.isclose(x, y, abs_tol=1e-6)) for x, y in zip(a, b, strict=True))


@pytest.fixture
def b(spark):
    df = generate.from_columns(spark, {"B": [0.0, 1.0, 2.0, math.nan, 4.0]})
    return Frame(df, "index")


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({"size": 2}, [None, 1, 3, None, None]),
        ({"size": 2, "min_periods": 1}, [0, 1, 3, 2, 4]),
        ({"size": 3, "min_periods": 1, "center": True}, [1, 3, 3, 6, 4]),
    ],
)
def test_rolling_sum(b, options, expected):
    assert near(column(b.rolling("sum", **options), "B"), expected)


def test_rolling_step(b):
    out = b.rolling("sum", 2, min_periods=1, step=2)
    assert column(out, "index") == [0, 2, 4] and near(column(out, "B"), [0, 3, 4])


@pytest.mark.parametrize(("closed", "expected"), [("left", [None, 1, 3, 5, 7]), ("right", [1, 3, 5, 7, 9]), ("both", [1, 3, 6, 9, 12]), ("neither", [None, 1, 2, 3, 4])])
def test_rolling_closed(spark, closed, expected):
    f = Frame(generate.from_columns(spark, {"A": [1.0, 2.0, 3.0, 4.0, 5.0]}), "index")
    assert near(column(f.rolling("sum", 2, min_periods=1, closed=closed), "A"), expected)


def test_expanding(spark):
    df = generate.from_columns(spark, {"k": [1] * 5, "B": [0.0, 1.0, 2.0, math.nan, 4.0]})
    f = Frame(df, "index", keys="k")
    assert near(column(f.expanding("sum"), "B"), [0, 1, 3, 3, 7])
    assert near(column(f.expanding("sum", min_periods=3), "B"), [None, None, 3, 3, 7])


@pytest.mark.parametrize(
    ("decay", "expected"),
    [
        ({}, [0, 0.75, 1.6153846, 1.6153846, 3.6702128]),
        ({"adjust": False}, [0, 0.6666667, 1.5555556, 1.5555556, 3.6507937]),
        ({"ignore_na": True}, [0, 0.75, 1.6153846, 1.6153846, 3.225]),
    ],
)
def test_ewm_mean(spark, decay, expected):
    df = generate.from_columns(spark, {"k": [1] * 5, "B": [0.0, 1.0, 2.0, math.nan, 4.0]})
    for f in (ewm.ewm, ewm.ewm_folded):
        assert near(column(f(df, "B", ["index"], ["k"], ewm.Decay(com=0.5, **decay), "mean", "x"), "x"), expected)


def test_ewm_others(spark):
    df = generate.from_columns(spark, {"k": [1] * 5, "x": [1.0, 2.0, 3.0, 4.0, 5.0], "y": [5.0, 3.0, 4.0, 6.0, 7.0], "B": [0.0, 1.0, 2.0, math.nan, 4.0]})
    d = ewm.Decay(com=0.5, min_periods=2)
    run = lambda stat, **kw: column(ewm.ewm(df, "x", ["index"], ["k"], d, stat, "out", other="y", **kw), "out")
    assert near(run("cov"), [None, -1, 0.0384615, 1.3538462, 1.5400826])
    assert near(run("cov", bias=True), [None, -0.375, 0.0177515, 0.66, 0.7636768])
    assert near(run("corr"), [None, -1, 0.0532998, 0.8466238, 0.9468896])
    assert near(column(ewm.ewm(df, "B", ["index"], ["k"], ewm.Decay(com=0.5), "sum", "out"), "out"), [0, 1, 2.3333333, 0.7777778, 4.2592593])


@pytest.mark.parametrize("decay", [{"com": 1}, {"span": 4, "adjust": False}, {"halflife": 2, "ignore_na": True}])
def test_ewm_var_like_pandas(spark, decay):
    import pandas as pd

    values = [1.0, 4.0, math.nan, 2.0, 8.0, 5.0]
    df = generate.from_columns(spark, {"k": [1] * 6, "x": values})
    want = pd.Series(values).ewm(**decay).var().tolist()
    got = column(ewm.ewm(df, "x", ["index"], ["k"], ewm.Decay(**decay), "var", "out"), "out")
    assert near(got, [None if math.isnan(v) else v for v in want])


def test_group_by(spark):
    df = generate.from_columns(spark, {"a": list(range(1, 11)), "b": list(range(10, 101, 10)), "c": [0, 0, 0, 0, 4, 4, 6, 8, 8, 8]})
    got = Frame(df, "index").group_by("c").agg("sum").collect()
    assert [tuple(r) for r in got] == [(0, 10, 100), (4, 11, 110), (6, 7, 70), (8, 27, 270)]


def test_mode_and_quantile(spark):
    df = generate.from_columns(spark, {"A": [1, 1, 2, 2, 3, 3, 4]})
    assert [r["A"] for r in aggregate.mode(df, "A", n=3).collect()] == [1, 2, 3]
    df = generate.from_columns(spark, {"A": [1.0, 2.0, 3.0, 4.0]})
    for how, want in {"lower": 2, "higher": 3, "midpoint": 2.5, "linear": 2.5}.items():
        assert df.agg(aggregate.down("quantile", F.col("A"), q=0.5, interpolation=how)).first()[0] == want


def test_exact_mean_does_not_drift(spark):
    mean = lambda rows: spark.createDataFrame([(x,) for x in rows], "v double").coalesce(1).agg(aggregate.down("mean", F.col("v"), exact=True)).first()[0]
    assert mean([0.1] * 10) == 0.1 and mean([1e16, 0.25, None, -1e16, 0.75]) == 0.25 and mean([1e300, 2.0]) == 5e299
    assert mean([None]) is None and mean([float("inf"), 1.0]) == float("inf") and str(mean([float("nan"), 1.0])) == "nan"


def test_frame_mean_rounds_its_true_value(spark, sf):
    path = str(Path(sf).parent / "sf0.01")  # 2995.11 / 60000 there, halfway between two roundings; a sum that drifts falls below
    assert QUERIES["frame_agg_down"](spark, path).first()["m"] == 0.049919


def test_across(spark):
    df = generate.from_columns(spark, {"A": [1.0, 2.0, 3.0, 4.0, 5.0], "B": [10.0, 20.0, 30.0, 40.0, 50.0], "C": [5.0, 30.0, 30.0, 0.0, 25.0]})
    assert column(Frame(df, "index").agg_rows("approximate_median"), "approximate_median") == [5, 20, 30, 4, 25]


def test_series_diffs(spark):
    f = Frame(generate.from_columns(spark, {"x": [5.0, 10.0, 12.0, 18.0, 25.0]}), "index")
    assert column(f.diff(1), "x") == [None, 5, 2, 6, 7] and column(f.diff(2), "x") == [None, None, 7, 8, 13]
    f = Frame(generate.from_columns(spark, {"x": [10.0, 15.0, 20.0, 25.0, 30.0]}), "index")
    assert near(column(f.pct_change(), "x"), [None, 0.5, 1 / 3, 0.25, 0.2])


def test_where_reindex(spark):
    f = Frame(generate.from_columns(spark, {"A": [1, 2, 3, 4, 5]}), "index")
    assert column(f.where(F.col("A") > 2, 0), "A") == [0, 0, 3, 4, 5]
    assert column(f.reindex(spark.range(7), 999), "A") == [1, 2, 3, 4, 5, 999, 999]


def test_aligned_arithmetic(spark):
    a = Frame(generate.from_columns(spark, {"x": [1, 2, 3]}, [0, 1, 2]), "index")
    b = Frame(generate.from_columns(spark, {"x": [10, 20, 30]}, [1, 2, 3]), "index")
    assert column(a + b, "x") == [None, 12, 23, None]
    assert column(10 - a, "x") == [9, 8, 7] and column(a * 2, "x") == [2, 4, 6]


def test_concat(spark):
    a, b = generate.from_columns(spark, {"p": [1, 2]}, [0, 1]), generate.from_columns(spark, {"q": [3, 4]}, [1, 2])
    outer, inner = combine.concat_columns([a, b], ["index"]), combine.concat_columns([a, b], ["index"], "inner")
    assert column(outer, "p") == [1, 2, None] and column(inner, "q") == [3]
    with pytest.raises(ValueError, match="share"):
        combine.concat_columns([a, a], ["index"])
    rows = combine.concat_rows([a, b])
    assert rows.columns == ["index", "p", "q"] and rows.count() == 4


@pytest.mark.parametrize(("keep", "want"), [("first", [10, 20, 40, 60]), ("last", [30, 40, 50, 60]), (False, [40, 60])])
def test_drop_duplicates(spark, keep, want):
    df = generate.from_rows(spark, list(zip(range(6), [1, 2, 1, 3, 2, 4], range(10, 61, 10), strict=True)), "ord long, k long, A long")
    assert sorted(r["A"] for r in select.drop_duplicates(df, ["k"], ["ord"], keep).collect()) == want


def test_positions_on_any_partitioning(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.col("id") * 7919, F.lit(1000)))
    for n in (1, 7):
        got = with_position(df.repartition(n), ["v"]).collect()
        assert all(r["pos"] == r["v"] for r in got)


def test_iloc(spark):
    f = Frame(generate.from_columns(spark, {"x": list(range(10))}), "index")
    for s in (slice(2, 8, 3), slice(-3, None), slice(8, 2, -2), slice(None, None, -1), slice(5, 5)):
        assert [r["x"] for r in f.iloc(s).df.collect()] == list(range(10))[s]
    assert [r["x"] for r in f.iloc([3, -1, 3]).df.collect()] == [3, 9, 3]
    assert f.row(4)["x"] == 4 and f.at(7, "x") == 7


def test_unkeyed_windows_cross_blocks(spark):
    from strandline.operators.position import over_blocks, running
    from pyspark.sql import Window  # noqa: F401

    df = with_position(spark.range(100).withColumn("v", F.col("id").cast("double")), ["id"])
    out = over_blocks(df, "pos", 4, 0, lambda w: {"s": F.sum("v").over(w.rowsBetween(-4, 0))}, block=7).orderBy("pos").collect()
    assert [r["s"] for r in out] == [sum(range(max(0, k - 4), k + 1)) for k in range(100)]
    run = running(df, "pos", {"t": (F.col("v"), F.sum, lambda a, b: a + b)}, block=9).orderBy("pos").collect()
    assert [r["t"] for r in run] == [sum(range(k + 1)) for k in range(100)]


def test_null_logic_and_rounding(spark):
    df = generate.from_rows(spark, [(2.5,), (-2.5,), (3.5,)], "x double")
    want = {"half_down": [2, -3, 3], "half_up": [3, -2, 4], "half_towards_zero": [2, -2, 3], "half_towards_infinity": [3, -3, 4], "half_to_even": [2, -2, 4], "half_to_odd": [3, -3, 3], "down": [2, -3, 3], "up": [3, -2, 4]}
    for mode, values in want.items():
        assert [r[0] for r in df.select(M.round_mode(F.col("x"), 0, mode)).collect()] == values
    got = spark.range(1).select(M.divide(F.lit(1.0), F.lit(0.0)), M.divide_int(F.lit(-7), F.lit(2)), M.ln(F.lit(0.0))).first()
    assert tuple(got) == (math.inf, -3, -math.inf)


def test_map_and_apply(spark):
    f = Frame(generate.from_columns(spark, {"x": [1.0, math.nan, 3.0]}), "index")
    assert column(f.map(lambda v: v * 2, "x", "double"), "x") == [2.0, None, 6.0]
    got = f.apply_rows(lambda r: {"index": r["index"], "y": r["index"] * 10}, "index long, y long")
    assert column(got, "y") == [0, 10, 20]


def test_equals(spark):
    a = Frame(generate.from_columns(spark, {"x": [1.0, 2.0]}), "index")
    assert a.equals(a + 1e-12) and not a.equals(a + 1)


def test_query_on_self(spark):
    df = generate.from_rows(spark, [(1, "a", 100.5), (2, "b", 200.3)], "id int, name string, value double")
    f = Frame(df, "id")
    assert f.query("SELECT name, CAST(value AS decimal(10, 2)) AS v FROM self WHERE value > 150").dtypes == [("name", "string"), ("v", "double")]
    with pytest.raises(Exception, match="cannot be resolved|UNRESOLVED"):
        f.query("SELECT id FROM self")


def test_files(spark, tmp_path):
    df = generate.from_rows(spark, [("Ann", 30, "Bern"), ("Bo", 41, "Oslo")], "Name string, Age long, City string")
    files.write_parquet(df, str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p"), [0, 2]).columns == ["Name", "City"]
    files.write_csv_file(df, str(tmp_path / "c"), delimiter=";")
    assert sorted(map(tuple, files.read_csv_file(spark, str(tmp_path / "c"), ";", schema=df.schema).collect())) == [("Ann", 30, "Bern"), ("Bo", 41, "Oslo")]
    assert files.read_csv(spark, "1,x\n2,y", header=False).columns == ["f0", "f1"]
    assert files.read_csv(spark, files.write_csv(df), columns=["Age"], dtype={"Age": "int"}).dtypes == [("Age", "int")]
    assert files.read_json(spark, '{"a": 1}\n{"a": 2}').count() == 2
    back, meta = files.from_ipc(spark, files.to_ipc(df, {"origin": "test"}))
    assert back.count() == 2 and meta["origin"] == "test"
    files.write_arrow(df, str(tmp_path / "f.arrow"))
    assert files.read_arrow(spark, str(tmp_path / "f.arrow"), ["City"]).columns == ["City"]


def test_generators(spark):
    assert generate.from_range(spark, 5, 0, -2).count() == 3
    got = [r[0] for r in generate.date_range(spark, dt.datetime(2024, 1, 15), periods=3, offset="ME").collect()]
    assert got == [dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 31)]
    assert generate.date_range(spark, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), offset="6h").count() == 5


def test_index(spark):
    from strandline.index import Index

    i = Index(generate.from_rows(spark, [(k, v) for k, v in enumerate([3, 1, 2, 2])], "ord long, k long"), "k", ["ord"])
    assert (i.min(), i.max(), i.argmin(), i.argmax(), i.size()) == (1, 3, 1, 0, 4)
    assert i.has_duplicates() and not i.contains(9) and i.get_loc(2) == [2, 3] and i.is_monotonic() == (False, False)
    assert i.delete(0).to_list() == [1, 2, 2] and i.drop_duplicates().to_list() == [3, 1, 2] and i.at(-1) == 2
    j = Index(i.labels, "k")
    assert j.slice_locs(2, 2) == (1, 3) and [r[0] for r in j.insert(0, 7).collect()] == [7, 1, 2, 2, 3]
    assert sorted(r[0] for r in j.union(Index(spark.range(2).toDF("x"), "x")).collect()) == [0, 1, 2, 3]


def test_window_apply(spark):
    f = Frame(generate.from_columns(spark, {"x": [1.0, 5.0, 2.0, 8.0]}), "index")
    assert column(f.rolling_apply(max, "x", 2, "m"), "m") == [1, 5, 5, 8]
    keyed = Frame(f.df.withColumn("k", F.lit(1)), "index", keys="k")
    assert column(keyed.expanding_apply(sum, "x", "s"), "s") == [1, 6, 8, 16]
