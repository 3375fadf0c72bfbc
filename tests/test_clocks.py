import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from roadloom.operators.clocks import instants_text, with_instants

LOADED = dt.datetime(2024, 6, 1)
FILES = "source_file string, zone_name string, date_order string, exported_at timestamp"
ROWS = "id int, source_file string, v string, loaded_at timestamp"


def read(spark, rows, files, **kw):
    df = spark.createDataFrame([(i, f, v, LOADED) for i, (f, v) in enumerate(rows)], ROWS)
    out = with_instants(df, spark.createDataFrame(files, FILES), ["v"], **kw)
    return [r[0] for r in out.orderBy("id").select(F.coalesce(instants_text(F.col("v_us"), F.col("v_word")), "v_word")).collect()]


LONDON = [("a", "Europe/London", "DMY", LOADED), ("m", "America/Chicago", "MDY", LOADED)]


@pytest.mark.parametrize(
    ("file", "value", "expected"),
    [
        ("a", "2024-01-31T05:06:07Z", "2024-01-31T05:06:07.000000Z"),
        ("a", " 2024-01-31T05:06:07.1234567+02:00\t", "2024-01-31T03:06:07.123456Z"),
        ("a", "2024-01-31T05:06:07-0930", "2024-01-31T14:36:07.000000Z"),
        ("a", "31/1/2024 5:06:07 PM", "2024-01-31T17:06:07.000000Z"),
        ("a", "31/01/2024 12:06:07 AM", "2024-01-31T00:06:07.000000Z"),
        ("a", "31-01-24 05:06", "2024-01-31T05:06:00.000000Z"),
        ("a", "1 Jul 2024 05:06:07", "2024-07-01T04:06:07.000000Z"),
        ("a", "20240701T050607Z", "2024-07-01T05:06:07.000000Z"),
        ("a", "2024-07-01 05:06:07 BST", "2024-07-01T04:06:07.000000Z"),
        ("m", "2024-07-01 05:06:07 CST", "2024-07-01T11:06:07.000000Z"),
        ("m", "07/01/2024 05:06:07", "2024-07-01T10:06:07.000000Z"),
        ("m", "13/01/2024 05:06:07", "unreadable"),
        ("a", "1635465636.5", "2021-10-29T00:00:36.500000Z"),
        ("a", "1635465636103", "2021-10-29T00:00:36.103000Z"),
        ("a", "31/03/2024 01:30:00", "skipped"),
        ("a", "27/10/2024 01:30:00", "ambiguous"),
        ("a", "27/10/2024 01:30:00 GMT", "2024-10-27T01:30:00.000000Z"),
        ("a", "29/02/2023 01:30:00", "unreadable"),
        ("a", "2024-01-31", "unreadable"),
        ("a", "13/01/2024 13:00:00 PM", "unreadable"),
        ("a", "2024-01-31 24:00:00", "unreadable"),
        ("a", "2024-07-01 05:06:07 CST", "unreadable"),
        ("a", "", None), ("a", "NA", None), ("a", None, None), (None, "2024-01-31 05:06:07", "no zone"), ("b", "2024-01-31T05:06:07Z", "2024-01-31T05:06:07.000000Z"),
    ],
)
def test_single_values(spark, file, value, expected):
    assert read(spark, [(file, value)], LONDON) == [expected]


def test_wall_clocks_agree_with_python(spark):
    zone, rows, expected = ZoneInfo("Australia/Adelaide"), [], []
    for h in range(0, 24 * 366, 7):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=h % 60)
        found = {t.replace(tzinfo=zone, fold=f).astimezone(dt.UTC) for f in (0, 1)}
        real = {u for u in found if u.astimezone(zone).replace(tzinfo=None) == t}
        rows.append(("x", f"{t:%Y-%m-%d %H:%M:%S}"))
        expected.append("skipped" if not real else "ambiguous" if len(real) > 1 else f"{real.pop():%Y-%m-%dT%H:%M:%S.000000Z}")
    assert read(spark, rows, [("x", "Australia/Adelaide", "DMY", LOADED)]) == expected


def test_order_of_dates_is_settled_by_the_file(spark):
    files = [("d", "UTC", None, None), ("m", "UTC", None, None), ("n", "UTC", None, dt.datetime(2024, 5, 4))]
    rows = [("d", "03/04/2024 01:00:00"), ("d", "25/04/2024 01:00:00"), ("m", "03/04/2024 01:00:00"), ("m", "03/25/2024 01:00:00"), ("n", "05/03/2024 01:00:00")]
    got = read(spark, rows, files)
    assert [x[:10] for x in got] == ["2024-04-03", "2024-04-25", "2024-03-04", "2024-03-25", "2024-05-03"]


def test_missing_zone_is_estimated_from_marked_times(spark):
    files = [("x", None, "DMY", None), ("known", "Australia/Sydney", "DMY", None), ("other", "Europe/London", "DMY", None)]
    rows = [("x", "2024-05-31T02:00:00Z"), ("x", "2024-05-31 12:05:00"), ("x", "2024-05-31T02:10:00Z"), ("x", "2024-05-31 12:15:00")]
    assert read(spark, rows, files)[1] == "2024-05-31T02:05:00.000000Z"


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", "x" * 200_000, LOADED, "keep", 5), (1, "a", "x" * 200_000, LOADED, "keep", 5)], ROWS + ", kind string, v_us int")
    out = with_instants(df, spark.createDataFrame(LONDON, FILES), ["v"])
    assert out.count() == 2 and out.columns == ["id", "source_file", "v", "loaded_at", "kind", "v_us", "v_word"]
    assert {r["v_word"] for r in out.collect()} == {"unreadable"}
    empty = with_instants(df.limit(0), spark.createDataFrame([], FILES), ["v"])
    assert empty.count() == 0


def test_session_zone_plays_no_part(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert read(spark, [("a", "2024-03-10 02:30:00"), ("a", "1 Jul 2024 05:06:07")], LONDON) == ["2024-03-10T02:30:00.000000Z", "2024-07-01T04:06:07.000000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
