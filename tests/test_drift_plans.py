import json

from pyspark.sql import functions as F
from test_drift import FILES, make
from test_plans import plan

from roadloom.operators.drift import migration_steps, schema_changes, whole_table


def test_rows_are_not_moved(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("feed_row_id"), F.lit("f").alias("feed"), (F.col("id") % 3).cast("int").alias("file_seq"), F.lit(json.dumps({"Lane": "L1", "x": 1})).alias("payload"))
    rows.write.parquet(str(tmp_path / "rows"))
    text = plan(whole_table(spark.read.parquet(str(tmp_path / "rows"))))
    tree = text[: text.index("\n\n")]
    joined = tree[: tree.index("BroadcastExchange")]  # the join and the rows' side
    assert "BroadcastHashJoin" in joined and "Scan parquet" in joined and "SortMergeJoin" not in joined and "Generate" not in joined and "- Exchange" not in joined and "Python" not in tree


def test_steps_are_between_versions(spark):
    steps = migration_steps(make(spark, FILES)).collect()
    assert {(r["feed"], r["version"], r["file_seq"]) for r in steps} == {("f", 2, 2), ("f", 3, 3), ("f", 4, 5), ("g", 2, 2)}
    retyped = {(r["old_name"], r["old_kind"], r["new_kind"]) for r in steps if r["change"] == "retyped"}
    assert retyped == {("Road_ID", "number", "string"), ("LANE", "string", "number"), ("note", "boolean", "string"), ("ROAD-ID", "string", "number")}
    assert schema_changes(make(spark, FILES)).count() == len(steps)


def test_equal_files_in_a_row_have_no_steps(spark):
    df = make(spark, [("f", i, [{"Lane": "L1", "n": i}]) for i in range(1, 6)])
    assert migration_steps(df).count() == 0
