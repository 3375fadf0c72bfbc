from pyspark.sql import functions as F
from test_plans import plan

from roadloom.common import BROADCAST_ROWS
from roadloom.operators.ranges import CELL, SPREAD, mark_in_range


def test_ranges_of_too_many_cells_are_not_broadcast(spark):
    """Few ranges by Spark's own estimate, too many once they stand in every cell that they cover."""
    count, width = 4000, SPREAD * CELL - 1
    assert count * SPREAD > BROADCAST_ROWS
    ranges = spark.range(count).select("id", F.lit(0.0).alias("lo"), F.lit(width).alias("hi"))
    facts = spark.range(count + 10).select("id", F.when(F.col("id") % 2 == 0, width).otherwise(width + 0.5).alias("v"))
    out = mark_in_range(facts, ranges, "id", "v", "hit", "id", "lo", "hi")
    assert "Broadcast" not in plan(out)
    rows = out.collect()
    assert "Broadcast" not in plan(out)  # nor later, by the sizes met on the way
    assert len(rows) == count + 10 and all(r["hit"] == (r["id"] < count and r["id"] % 2 == 0) for r in rows)
