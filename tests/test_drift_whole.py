import json

from roadloom.operators.drift import reading_steps, whole_table

SCHEMA = "feed_row_id bigint, feed string, file_seq int, payload string, name string, kind string, field int"


def make(spark, files):
    rows, i = [], 0
    for feed, seq, payloads in files:
        for p in payloads:
            i += 1
            rows.append((i, feed, seq, p if p is None or isinstance(p, str) else json.dumps(p), "clash", "clash", 1))
    return spark.createDataFrame(rows, SCHEMA)


def test_no_field_is_lost(spark):
    df = make(spark, [
        ("f", 1, [{"BinViewerVersion": "4.0.0", "tsd_slope2000": 10.0, "crew_note": "wet", "Lane": "L1"}, None, "[1]"]),
        ("f", 2, [{"gps_fix": True, "Crew-Note": "dry", "Direction": "inc", "nested": {"a": [1, 2]}, "x": None}]),
        (None, 1, [{"Lane": "L2", "new": "y"}]),
    ])
    rows = {r["feed_row_id"]: r for r in whole_table(df).collect()}
    assert len(rows) == 5
    assert (rows[1]["BinViewerVersion"], float(rows[1]["tsdSlope2000"]), rows[1]["Lane"], rows[1]["others"]) == ("4.0.0", 10, "L1", {"crewnote": "wet"})
    assert rows[2]["others"] == rows[3]["others"] == {} and rows[2]["Lane"] is None
    assert rows[4]["Travel"] == "inc" and rows[4]["others"] == {"crewnote": "dry", "gpsfix": "true", "nested": '{"a":[1,2]}'}
    assert rows[5]["Lane"] == "L2" and rows[5]["others"] == {"new": "y"} and rows[5]["version"] is None
    assert [rows[i]["version"] for i in (1, 2, 3, 4)] == [1, 1, 1, 2]


def test_steps_of_a_version(spark):
    df = make(spark, [
        ("f", 1, [{"Chainage": 10684.1, "Ignore": "T", "tsdSlope2000": "1,010.5"}, {"Chainage": "7,500.25 m", "Ignore": "NA"}]),
        ("f", 2, [{"location": "7.637 km", "skip": 0}, {"location": 3.7116, "skip": 1}, {"location": "12 m", "skip": False}]),
        ("f", 3, [{"CHAINAGE": "far", "Skip": "maybe", "RoadID": "R8908"}, {"CHAINAGE": "1.5 km", "RoadID": 1178.0}]),
    ])
    rows = {r["feed_row_id"]: r for r in whole_table(df).collect()}
    assert [rows[i]["Chainage"] for i in range(1, 8)] == [10684.1, 7500.25, 7637.0, 3711.6, 12.0, None, 1500.0]
    assert [rows[i]["Ignore"] for i in range(1, 8)] == [True, None, False, True, False, None, None]
    assert rows[1]["tsdSlope2000"] == 1010.5 and [rows[i]["RoadID"] for i in (6, 7)] == ["R8908", "1178"]
    assert rows[6]["unread"] == {"Chainage": "far", "Ignore": "maybe"} and all(rows[i]["unread"] == {} for i in range(1, 8) if i != 6)
    steps = {(r["version"], r["old_name"]): (r["new_name"], r["cast"], r["exponent"]) for r in reading_steps(df).collect()}
    assert steps[1, "Chainage"] == ("Chainage", "metres", 0) and steps[2, "location"] == ("Chainage", "metres", 3) and steps[2, "skip"] == ("Ignore", "flag", 0)


def test_defaults_fill_versions_that_lack_a_field(spark):
    df = make(spark, [("f", 1, [{"Lane": "L1"}]), ("f", 2, [{"Lane": "L1", "Ignore": None}, {"Ignore": True}]), (None, 1, [{"Lane": "L2"}])])
    rows = whole_table(df, defaults={"Ignore": "false", "Lane": "L9"}).collect()
    assert {r["feed_row_id"]: (r["Ignore"], r["Lane"]) for r in rows} == {1: (False, "L1"), 2: (None, "L1"), 3: (True, None), 4: (False, "L2")}
