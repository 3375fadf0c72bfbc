"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from roadloom import common
from roadloom.common import lookup_join
from roadloom.operators.clocks import with_instants
from roadloom.operators.ranges import mark_in_range


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def lmd(spark, tmp_path):
    path = str(tmp_path / "lmd")
    rows = spark.range(1000).select("id", F.lit("f").alias("source_file"), F.lit("2024-01-01 00:00:00").alias("v"), F.lit("x").alias("unused"), F.current_timestamp().alias("loaded_at"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_times_are_read_without_moving_the_facts(spark, lmd):
    files = spark.createDataFrame([("f", "UTC", "DMY", None)], "source_file string, zone_name string, date_order string, exported_at timestamp")
    text = plan(with_instants(lmd, files, ["v"]).select("id", "v_us").where("v_us is not null"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    schema = re.search(r"ReadSchema: (\S+)", text)[1]
    assert "unused" not in schema and "loaded_at" not in schema
    assert "Python" not in text


def test_marks_move_no_facts(spark, lmd):
    ranges = spark.createDataFrame([(1, 0.0, 5.0)], "k bigint, lo double, hi double")
    text = plan(mark_in_range(lmd.withColumn("x", F.col("id").cast("double")), ranges, "id", "x", "hit", "k", "lo", "hi"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_a_long_side_is_not_broadcast_but_salted(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(1000).select(F.lit(1).alias("k"), "id")
        small = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k int, v string")
        out = lookup_join(facts, small, ["k"], limit=10)
        assert "Broadcast" not in plan(out) and out.where("v = 'v1'").count() == 1000 and out.columns == ["k", "id", "v"]
        salts = facts.select(F.pmod(F.xxhash64("k", "id"), F.lit(common.SALTS)).alias("s")).groupBy("s").count().collect()
        assert len(salts) == common.SALTS
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
