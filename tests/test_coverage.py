import random

import pytest

from roadloom.operators.coverage import combine_summaries, continuous_periods

SCHEMA = "plate string, s bigint, e bigint, key string, kind int"


def brute(rows):
    out, by = set(), {}
    for p, s, e, *_ in rows:
        if p is not None and s is not None and e is not None and s <= e:
            by.setdefault(p, []).append((s, e))
    for p, spans in by.items():
        spans.sort()
        a, b = spans[0]
        for s, e in spans[1:]:
            if s <= b:
                b = max(b, e)
            else:
                out |= {(p, "period", a, b), (p, "gap", b, s)}
                a, b = s, e
        out.add((p, "period", a, b))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, seed, parts):
    rng = random.Random(seed)
    plates = ["hot"] * 4 + ["a", "b", "c", None]
    rows = []
    for _ in range(400):
        s = rng.choice([None, *range(0, 2000, 3)]) if rng.random() < 0.05 else rng.randrange(2000)
        length = rng.choice([0, 1, 3, 10, -5, 900 if rng.random() < 0.02 else 2])
        rows.append((rng.choice(plates), s, None if s is None or rng.random() < 0.02 else s + length, "x", 1))
    rows += rows[:50]
    got = [tuple(r) for r in continuous_periods(spark.createDataFrame(rows, SCHEMA), "plate", "s", "e", parts).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_one_long_interval_carries_through_all_partitions(spark):
    rows = [("p", 0, 10_000, "", 0)] + [("p", i, i + 1, "", 0) for i in range(5, 9_000, 10)] + [("p", 10_000, 10_001, "", 0), ("q", 1, 1, "", 0)]
    got = {tuple(r) for r in continuous_periods(spark.createDataFrame(rows, SCHEMA), "plate", "s", "e", 8).collect()}
    assert got == {("p", "period", 0, 10_001), ("q", "period", 1, 1)}


def test_empty(spark):
    assert continuous_periods(spark.createDataFrame([], SCHEMA), "plate", "s", "e").count() == 0


def test_summaries_combine_in_order():
    assert combine_summaries([(0, "a", "a", 50, 0), (1, "a", "a", 20, 15), (2, "a", "b", 9, 7), (3, "b", "b", 12, 12)]) == {1: ("a", 50, 0), 2: ("a", 50, 0), 3: ("b", 9, 7)}
