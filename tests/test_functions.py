import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadloom.functions import scalars, timestamps


def one(spark, expr, *values, schema=None):
    df = spark.createDataFrame([values], schema or ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize(
    ("lane", "fix", "out"),
    [("L1", "2", "L2"), ("L1A", "2", "L2A"), ("1", "4", "4"), ("L1", "TURN", "TURN"), ("L1", "-1", "L1"), ("L1", "12", "L12"), (None, "2", "2"), ("L1", None, "L1"), (None, None, None), ("", "3", "3")],
)
def test_rewrite_lane(spark, lane, fix, out):
    assert one(spark, scalars.rewrite_lane, lane, fix) == out


@pytest.mark.parametrize(("text", "out"), [("M1 North A", "M1 North"), ("Ring", "Ring"), ("A B  ", "A B "), (" A", ""), (None, None)])
def test_without_last_word(spark, text, out):
    assert one(spark, scalars.without_last_word, text) == out


@pytest.mark.parametrize(("text", "out"), [*[(t, True) for t in scalars.TRUE_TOKENS], *[(t, False) for t in scalars.FALSE_TOKENS], (" \t1\n", True), ("yes", None), ("2", None), (None, None)])
def test_booleans(spark, text, out):
    assert one(spark, scalars.parse_boolean, text) is out
    assert one(spark, lambda c: scalars.boolean_text(scalars.parse_boolean(c)), text) == (None if out is None else str(out))


@pytest.mark.parametrize(("km", "m"), [(1.196, 1200), (1.304, 1300), (0.015, 20), (0.025, 20), (None, None)])
def test_rounding(spark, km, m):
    assert one(spark, scalars.round_to_10m, km, schema="c double") == m


def test_null_tokens_and_numbers(spark):
    df = spark.createDataFrame([("", "NULL"), ("null", "NA"), ("na", "N/A")], "`a b.c` string, n string")
    assert [tuple(r) for r in scalars.nulls_of_tokens(df).collect()] == [(None, None), (None, None), ("na", "N/A")]
    assert one(spark, scalars.number, "7.0") == 7.0 and one(spark, scalars.number, "x") is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, lambda c: scalars.number(c, strict=True), "x")


@pytest.mark.parametrize(("us", "text", "s"), [(103_999, "01/01/1970 00:00:00.103", 0), (-500_000, "31/12/1969 23:59:59.500", -1), (1_730_161_236_103_000, "29/10/2024 00:20:36.103", 1_730_161_236)])
def test_times_out(spark, us, text, s):
    assert one(spark, scalars.standard_time_text, us, schema="c bigint") == text and one(spark, scalars.epoch_seconds, us, schema="c bigint") == s


def us(*parts):
    return int((dt.datetime(*parts, tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))


def parse(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    out, choice = timestamps.parse_column(df, "v", [F.col("i")], "us")
    got = [r["us"] for r in out.orderBy("i").collect()]
    if choice.format:
        assert choice.failures == sum(v is not None and g is None for v, g in zip(values, got)) == out.agg(timestamps.parse_failures("v", "us")).first()[0]
        assert len(timestamps.failing_samples(out, "v", "us")) == min(3, choice.failures)
    return got, choice.format


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2024-10-29T00:20:36.103Z", us(2024, 10, 29, 0, 20, 36, 103000)), ("2024-10-29T00:20:36", us(2024, 10, 29, 0, 20, 36)),
        ("2024-10-29T00:20:36.1+02:00", us(2024, 10, 28, 22, 20, 36, 100000)), ("2024-10-29T00:20:36+0200", us(2024, 10, 28, 22, 20, 36)),
        ("29/10/2024 00:20:36", us(2024, 10, 29, 0, 20, 36)), ("10/29/2024 00:20:36", us(2024, 10, 29, 0, 20, 36)), ("1/2/2024 3:20:36", us(2024, 2, 1, 3, 20, 36)),
        ("29-10-2024 00:20:36.5", us(2024, 10, 29, 0, 20, 36, 500000)), ("2024-10-29 0:20:36", us(2024, 10, 29, 0, 20, 36)),
        ("29/10/68 00:20:36", us(2068, 10, 29, 0, 20, 36)), ("29/10/69 00:20:36", us(1969, 10, 29, 0, 20, 36)), ("1635465636.5", us(2021, 10, 29, 0, 0, 36, 500000)),
        ("1635465636103", us(2021, 10, 29, 0, 0, 36, 103000)), ("2024-10-29", us(2024, 10, 29)), ("2/1/2024", us(2024, 1, 2)), ("29.10.2024 01:02", us(2024, 10, 29, 1, 2)),
        ("29 Oct 2024 01:02:03", us(2024, 10, 29, 1, 2, 3)), ("31/02/2024 00:00:00", None), ("rubbish", None),
    ],
)
def test_families(spark, value, expected):
    got, fmt = parse(spark, [value] * 10)
    assert got == [expected] * 10 and (fmt is None) == (expected is None)


def test_one_format_per_column(spark):
    got, _ = parse(spark, ["2024-10-29T00:20:36.103Z"] * 6 + ["2024-10-29T00:20:36Z"] * 4)
    assert [g is None for g in got] == [False] * 6 + [True] * 4
    got, fmt = parse(spark, ["01/02/2024 00:00:00"] * 6 + ["10/29/2024 00:00:00"] * 4)
    assert fmt == "d/M/yyyy H:mm:ss" and got[0] == us(2024, 2, 1) and got[9] is None
    got, fmt = parse(spark, ["29/10/2024 00:00:00"] * 8 + ["x"] * 2)
    assert got[0] and got[9] is None
    got, fmt = parse(spark, ["2024-10-29"] * 5 + [None] * 5)
    assert fmt is not None and got[0] == us(2024, 10, 29)


def test_detection(spark):
    assert timestamps.detect_family([]) is None and timestamps.detect_family(["1635465636"] * 8 + ["x"] * 2).name == "unix_s"
    assert timestamps.detect_family(["1635465636"] * 7 + ["x"] * 3) is None and "iso" in timestamps.supported_formats()
    df = spark.createDataFrame([(1, "x"), (2, "aTb")], "i int, v string")
    assert timestamps.has_iso_times(df, "v", [F.col("i")]) and not timestamps.has_iso_times(df.limit(0), "v", [F.col("i")])
    with pytest.raises(timestamps.TimestampError):
        timestamps.parse_column(df, "v", [F.col("i")], "us", required=True)
