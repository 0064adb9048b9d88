"""String functions on known values, and streaming forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from strandline.functions import logic as L
from strandline.functions import strings as S
from strandline.streaming import operators as streaming


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(df, c):
    return df.select(c).first()[0]


CASES = [
    (lambda: S.utf8_title(F.lit("o'neil a-b éa")), "O'Neil A-B Éa"),
    (lambda: S.ascii_title(F.lit("hello wORLD")), "Hello World"),
    (lambda: S.utf8_swapcase(F.lit("aBÉ")), "Abé"),
    (lambda: S.ascii_swapcase(F.lit("aBÉ")), "AbÉ"),
    (lambda: S.utf8_capitalize(F.lit("éAB")), "Éab"),
    (lambda: S.center(F.lit("abc"), 5), " abc "),
    (lambda: S.center(F.lit("ab"), 5, "-"), "-ab--"),
    (lambda: S.lpad(F.lit("abcdef"), 3), "abcdef"),
    (lambda: S.rpad(F.lit("ab"), 4, "0"), "ab00"),
    (lambda: S.trim_whitespace(F.lit("\t x  ")), "x"),
    (lambda: S.ltrim(F.lit("xxay"), "xy"), "ay"),
    (lambda: S.rtrim(F.lit("axyy"), "xy"), "a"),
    (lambda: S.replace_slice(F.lit("abcdef"), 1, 3, "-"), "a-def"),
    (lambda: S.replace_slice(F.lit("abcdef"), -2, 99, "-"), "abcd-"),
    (lambda: S.replace_substring(F.lit("a.b.c.d"), ".", "-", 2), "a-b-c.d"),
    (lambda: S.replace_substring(F.lit("a.b"), ".", "-", 5), "a-b"),
    (lambda: S.find_substring(F.lit("éa"), "a"), 2),
    (lambda: S.find_substring(F.lit("b"), "a"), -1),
    (lambda: S.count_substring(F.lit("a.A.a"), "a.", True), 2),
    (lambda: S.slice_codeunits(F.lit("abcdef"), -4, -1), "cde"),
    (lambda: S.slice_codeunits(F.lit("abcdef"), 0, None, 2), "ace"),
    (lambda: S.split_pattern(F.lit("a.b.c"), ".", 1), ["a", "b.c"]),
    (lambda: S.split_pattern(F.lit("a.b.c"), ".", 1, True), ["a.b", "c"]),
    (lambda: S.split_whitespace(F.lit("a  b\tc")), ["a", "b", "c"]),
    (lambda: S.matches_class(F.lit(""), "ascii_is_alpha"), False),
    (lambda: S.matches_class(F.lit("é1"), "utf8_is_alnum"), True),
    (lambda: S.ascii_is_title(F.lit("Hello World")), True),
    (lambda: S.utf8_is_upper(F.lit("ÉA1")), True),
    (lambda: S.is_ascii(F.lit("é")), False),
    (lambda: S.strptime(F.lit("2024-03-05 07:08"), "%Y-%m-%d %H:%M"), dt.datetime(2024, 3, 5, 7, 8)),
    (lambda: S.strptime(F.lit("x"), "%Y", True), None),
    (lambda: S.starts_with(F.lit("Hello"), "he", True), True),
    (lambda: L.isin(F.lit(None).cast("int"), [1, None]), True),
    (lambda: L.where(F.lit(None).cast("boolean"), F.lit(1), F.lit(2)), None),
    (lambda: L.equal(F.lit(float("nan")), F.lit(float("nan"))), False),
    (lambda: L.is_inf(F.lit(float("-inf"))), True),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_value(one, k):
    make, want = CASES[k]
    assert value(one, make()) == want


def test_unknown_directive():
    with pytest.raises(ValueError, match="no counterpart"):
        S.java_pattern("%q")


def run_stream(spark, df, out, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "rows")
    rows = [(k % 7 * 3 + k // 7, dt.datetime(2024, 1, 1, 0, k), "ab"[k % 2], float(k)) for k in range(40)] + [(0, dt.datetime(2024, 1, 1, 0, 0), "a", 0.0), (99, dt.datetime(2024, 1, 2), "a", 1.0)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k string, v double")
    df.coalesce(1).write.parquet(path)
    return df, lambda: spark.readStream.schema(df.schema).parquet(path)


def test_stream_bars(spark, stream):
    df, read = stream
    got = run_stream(spark, df, streaming.bars(read(), "ts", "v", "10 minutes", ["k"], "1 minute"), "bars_out", "update").where("bucket < '2024-01-02'")
    want = df.where("ts < '2024-01-02'").groupBy(F.window("ts", "10 minutes"), "k").agg(F.sum("v").alias("v"))
    assert sorted(r["volume"] for r in got.collect()) == sorted(r["v"] for r in want.collect())


def test_stream_dedup_and_ewm(spark, stream):
    df, read = stream
    assert run_stream(spark, df, streaming.deduplicated(read(), "ts", ["ts", "k"]), "dedup_out").count() == df.dropDuplicates(["ts", "k"]).count()
    got = run_stream(spark, df, streaming.ewm_mean(read().where("id < 99"), "k", "ts", "v", 0.5), "ewm_out").where("k = 'b'").orderBy("ts").collect()
    import pandas as pd

    want = pd.Series([r["v"] for r in got]).ewm(alpha=0.5).mean()
    assert [round(r["ewm_mean"], 9) for r in got] == [round(x, 9) for x in want]
