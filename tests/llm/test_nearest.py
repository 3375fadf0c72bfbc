import random

import pytest

from roadloom.llm import nearest
from roadloom.llm.nearest import pair_nearest

SCHEMA = "key string, t bigint, id bigint, lo string, cell int"


def brute(left, right, tolerance):
    out = []
    for k, t, i, *_ in left:
        near = [(abs(t - rt), ri) for rk, rt, ri, *_ in right if None not in (k, t, rk, rt, ri) and rk == k and abs(rt - t) <= tolerance]
        if near:
            out.append((i, min(near)[1]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("tolerance", [1, 4, 25])
def test_against_brute_force(spark, seed, tolerance):
    rng = random.Random(seed)
    row = lambda i, span: (rng.choice(["hot", "hot", "b", None]), rng.choice([None] + list(range(-span, span)) * 2), i, "x", 1)
    right = [row(i, 900) for i in range(150)]
    right += [(k, t, i + 500, "x", 1) for k, t, i, *_ in right[:40]]
    left = [row(i, 1000) for i in range(400)]
    left += left[:20]
    got = pair_nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), tolerance).collect()
    assert sorted(map(tuple, got)) == brute(left, right, tolerance)


def test_a_long_index_is_not_broadcast(spark, monkeypatch):
    right = [("k", 10 * i, i, "", 0) for i in range(60)]
    left = [("k", t, t, "", 0) for t in range(-5, 620)]
    sides = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    assert sorted(map(tuple, pair_nearest(*sides, 3).collect())) == brute(left, right, 3)
    assert "BroadcastHashJoin" in pair_nearest(*sides, 3)._jdf.queryExecution().toString()
    monkeypatch.setattr(nearest, "BROADCAST_INDEX", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pair_nearest(*sides, 3)
        assert "SortMergeJoin" in out._jdf.queryExecution().toString() and sorted(map(tuple, out.collect())) == brute(left, right, 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_of_stretches_and_empty_tables(spark):
    right = [("k", 720 * 5 - 1, 2, "", 0), ("k", 720 * 5 + 2, 1, "", 0)]
    left = [("k", t, t, "", 0) for t in range(720 * 5 - 8, 720 * 5 + 9)]
    r, lt = spark.createDataFrame(right, SCHEMA), spark.createDataFrame(left, SCHEMA)
    assert sorted(map(tuple, pair_nearest(lt, r, 5).collect())) == brute(left, right, 5)
    assert pair_nearest(lt.limit(0), r, 5).count() == 0 and pair_nearest(lt, r.limit(0), 5).count() == 0
