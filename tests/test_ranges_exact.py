import random

import pytest
from pyspark.sql import functions as F

from roadloom.operators.ranges import mark_in_range


def naive(facts, ranges):
    return {i: any(None not in (k, v, rk, lo, hi) and rk == k and lo <= v <= hi for rk, lo, hi in ranges) for i, k, v in facts}


def marks(spark, facts, ranges, key="bigint", range_key="bigint"):
    out = mark_in_range(spark.createDataFrame(facts, f"id int, k {key}, v double"), spark.createDataFrame(ranges, f"k {range_key}, lo double, hi double"), "k", "v", "hit", "k", "lo", "hi")
    return {r["id"]: r["hit"] for r in out.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_fine_ends_and_widths_of_all_sizes(spark, seed):
    rng = random.Random(seed)
    ranges = []
    for _ in range(60):
        lo = rng.choice([rng.uniform(-50, 50), rng.uniform(-1e7, 1e7), rng.uniform(-1e12, 1e12)])
        ranges.append((rng.choice([1, 2, None]), lo, lo + rng.choice([0.0, rng.random() / 1e4, rng.uniform(0, 10), rng.uniform(0, 1e6), -1.0])))
    ranges += [(3, -1e12, 1e12), (4, float("-inf"), 5.0), (4, 7.0, float("inf")), (5, float("nan"), 1.0), (5, 0.0, float("nan"))]
    facts = [(i, rng.choice([1, 2, 3, 4, 5, None]), rng.choice([None, float("nan"), rng.uniform(-60, 60), rng.uniform(-1e12, 1e12)])) for i in range(300)]
    for _, lo, hi in ranges:  # the very ends, and what lies just outside
        facts += [(len(facts) + j, rng.choice([1, 2, 3, 4]), v) for j, v in enumerate((lo, hi, lo - abs(lo) * 1e-15, hi + abs(hi) * 1e-15))]
    facts += [(len(facts), 1, 1.0008), (len(facts) + 1, 6, 0.0)]
    ranges += [(6, -0.0, 0.0), (1, 0.0, 1.0004)]
    plain = [(k, lo, hi) for k, lo, hi in ranges if lo == lo and hi == hi]
    assert marks(spark, facts, ranges) == naive(facts, plain)


@pytest.mark.parametrize(("key", "range_key"), [("bigint", "double"), ("double", "int"), ("decimal(10,2)", "bigint"), ("int", "bigint")])
def test_numeric_keys_of_different_types(spark, key, range_key):
    facts = spark.createDataFrame([(1, 1.5), (2, 1.5)], "id int, v double").withColumn("k", F.col("id").cast(key))
    ranges = spark.createDataFrame([(1.0, 2.0)], "lo double, hi double").withColumn("k", F.lit(1).cast(range_key))
    assert {r["id"]: r["hit"] for r in mark_in_range(facts, ranges, "k", "v", "hit", "k", "lo", "hi").collect()} == {1: True, 2: False}


def test_keys_of_different_kinds_are_an_error(spark):
    facts, ranges = spark.createDataFrame([("1", 1.0)], "k string, v double"), spark.createDataFrame([(1, 0.0, 2.0)], "k int, lo double, hi double")
    with pytest.raises(TypeError):
        mark_in_range(facts, ranges, "k", "v", "hit", "k", "lo", "hi")
    text = mark_in_range(facts, ranges.withColumn("k", F.col("k").cast("string")), "k", "v", "hit", "k", "lo", "hi")
    assert text.first()["hit"] and text.columns == ["k", "v", "hit"]
    names = facts.selectExpr("k", "v", "1 AS __k", "2 AS __at", "3 AS __cell", "4 AS `a.b`")
    assert tuple(mark_in_range(names, ranges.withColumn("k", F.col("k").cast("string")), "k", "v", "hit", "k", "lo", "hi").first()) == ("1", 1.0, 1, 2, 3, 4, True)
