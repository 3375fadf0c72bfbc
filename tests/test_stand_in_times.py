import datetime as dt

from pyspark.sql import functions as F

from roadloom.plans.catalogue import _micros


def test_times_without_zone_do_not_depend_on_the_session(spark):
    times = [dt.datetime(2024, 3, 31, 2, 30, 1, 250_001), dt.datetime(2024, 10, 27, 2, 30), dt.datetime(1969, 12, 31, 23, 59, 59, 999_999)]
    expected = [int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for t in times]
    try:
        for zone in ("UTC", "Europe/Berlin", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame([(i, str(t)) for i, t in enumerate(times)], "i int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
            assert [r[0] for r in df.orderBy("i").select(_micros(F.col("t"))).collect()] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
