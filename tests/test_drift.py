import json

from roadloom.operators.drift import schema_changes, unified_table, unified_values, version_fingerprints

SCHEMA = "feed_row_id bigint, feed string, file_seq int, payload string, name string, kind string, field int"


def make(spark, files):
    rows, i = [], 0
    for feed, seq, payloads in files:
        for p in payloads:
            i += 1
            rows.append((i, feed, seq, p if p is None or isinstance(p, str) else json.dumps(p), "clash", "clash", 1))
    return spark.createDataFrame(rows, SCHEMA)


FILES = [
    ("f", 1, [{"Lane": "L1", "RoadID": 5}, {"Lane": None, "RoadID": 7.0}]),
    ("f", 2, [{"lane": "L1", "Road_ID": "5"}, {"lane": "L1", "Road_ID": "5"}]),
    ("f", 3, [{"LANE": None, "note": True}]),
    ("f", 5, [{"LANE": 3, "note": "x", "ROAD-ID": 4}]),
    ("g", 1, [None, "not json", "[1,2]"]),
    ("g", 2, [{"start_time": "a", "x" * 50_000: "y"}]),
    (None, 1, [{"a": 1}]),
    ("h", None, [{"a": 1}]),
]


def test_changes(spark):
    got = sorted(tuple(r) for r in schema_changes(make(spark, FILES)).collect())
    assert got == sorted([
        ("f", 2, "renamed", "Lane", "lane"), ("f", 2, "renamed", "RoadID", "Road_ID"), ("f", 2, "retyped", "Road_ID", "Road_ID"),
        ("f", 3, "renamed", "lane", "LANE"), ("f", 3, "removed", "Road_ID", ""), ("f", 3, "added", "", "note"),
        ("f", 5, "retyped", "LANE", "LANE"), ("f", 5, "retyped", "note", "note"), ("f", 5, "added", "", "ROAD-ID"), ("f", 5, "retyped", "ROAD-ID", "ROAD-ID"),
        ("g", 2, "added", "", "start_time"), ("g", 2, "added", "", "x" * 50_000),
    ])


def test_unified(spark):
    df = make(spark, FILES[:4])
    rows = {r["feed_row_id"]: r.asDict() for r in unified_table(df, ["Lane", "RoadID"]).collect()}
    assert {i: (r["Lane"], r["RoadID"]) for i, r in rows.items()} == {1: ("L1", "5"), 2: (None, "7"), 3: ("L1", "5"), 4: ("L1", "5"), 5: (None, None), 6: ("3", "4")}
    assert [rows[i]["version"] for i in (1, 2, 3, 5, 6)] == [1, 1, 2, 3, 4]
    assert {r["kind"] for r in unified_values(df).where("field = 'Lane'").collect()} == {"string"}
    assert version_fingerprints(df).count() == 4


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert schema_changes(df).count() == 0 and unified_table(df, ["Lane"]).count() == 0
