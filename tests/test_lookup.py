import random

import pytest
from pyspark.sql import functions as F

from roadloom.operators.lookup import FIRST_LISTED, LATEST_START, lookup_interval
from roadloom.operators.ranges import mark_in_range
from roadloom.streaming.lookup import stream_lookup

FIX = "k string, ord int, start bigint, `end` bigint, payload string"
FACT = "id int, k string, t bigint, payload int, chunk int"


def brute(facts, fixes, policy, keyed):
    out = {}
    for i, k, t, *_ in facts:
        hit = None
        own = [f for f in fixes if None not in (f[2], f[3], t) and (not keyed or (k is not None and f[0] == k))]
        if policy == FIRST_LISTED:
            hit = min((f for f in own if f[2] <= t <= f[3]), key=lambda f: f[1], default=None)
        else:
            last = max((f for f in own if f[2] <= t), key=lambda f: (f[2], f[1]), default=None)
            hit = last if last and t <= last[3] else None
        out[i] = hit and hit[4]
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("policy", [FIRST_LISTED, LATEST_START])
@pytest.mark.parametrize("keyed", [False, True])
def test_against_brute_force(spark, seed, policy, keyed):
    rng = random.Random(seed)
    fixes = []
    for i in range(60):
        s = rng.choice([None] + list(range(-200, 300)) * 2)
        e = None if s is None or rng.random() < 0.05 else s + rng.choice([0, 1, 5, 30, -3, 400])
        fixes.append((rng.choice("ab"), i, s, e, f"p{i}"))
    facts = [(i, rng.choice(["a", "b", None]), rng.choice([None] + list(range(-250, 700)) * 3), 1, 1) for i in range(400)]
    df = lookup_interval(spark.createDataFrame(facts, FACT), spark.createDataFrame(fixes, FIX), "t", policy, ["k"] if keyed else None, "found", width=32)
    got = [(r["id"], r["found"]) for r in df.collect()]
    assert len(got) == len(facts) and dict(got) == brute(facts, fixes, policy, keyed)
    assert df.columns == ["id", "k", "t", "payload", "chunk", "found"]


def test_empty_sides_and_open_ends(spark):
    facts, fixes = spark.createDataFrame([(1, "a", 5, 0, 0)], FACT), spark.createDataFrame([("a", 1, -62_135_596_800, 10**12, "x")], FIX)
    assert lookup_interval(facts, fixes.limit(0), "t").first()["payload"] is None
    assert lookup_interval(facts.limit(0), fixes, "t").count() == 0
    for policy in (FIRST_LISTED, LATEST_START):
        assert lookup_interval(facts, fixes, "t", policy).first()["payload"] == "x"


def test_the_facts_are_not_shuffled(spark):
    facts, fixes = spark.range(10).select(F.col("id").alias("t")), spark.createDataFrame([("a", 1, 1, 5, "x")], FIX)
    out = lookup_interval(facts, fixes, "t")
    assert out.count() == 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Python" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_marks(spark, seed):
    rng = random.Random(seed)
    ranges = [(rng.choice([1.0, 2.0, None]), float(s), float(s + rng.choice([0, 5, 40, -1]))) for s in rng.sample(range(3000), 80)] + [(1.0, None, 5.0)]
    facts = [(i, rng.choice([1.0, 2.0, 3.0, None]), rng.choice([None, *[x / 2 for x in range(6000)]]), True) for i in range(500)]
    out = mark_in_range(spark.createDataFrame(facts, "id int, k double, v double, hit boolean"), spark.createDataFrame(ranges, "k double, lo double, hi double"), "k", "v", "hit", "k", "lo", "hi")
    expected = {i: any(None not in (k, v, rk, lo, hi) and rk == k and lo <= v <= hi for rk, lo, hi in ranges) for i, k, v, _ in facts}
    rows = out.collect()
    assert len(rows) == 500 and {r["id"]: r["hit"] for r in rows} == expected


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, t bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t bigint").parquet(str(tmp_path / "in"))
    fixes = spark.createDataFrame([("a", 1, 0, 10, "x"), ("a", 2, 4, 20, "y")], FIX)
    query = stream_lookup(stream, fixes, "t", (0, 100)).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["id"], r["payload"]) for r in spark.table("found").collect()) == [(1, "x"), (2, None), (3, None)]
