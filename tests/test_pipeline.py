import datetime
import glob

import pytest

from roadloom.plans.pipeline import FIRST_LISTED, LATEST_START, apply_lane_fixes, flag_in_brief, guard_rows, run_brief, run_lane_fixes, run_pipeline
from roadloom.schema import SchemaError, file_kind, missing_exact, missing_flexible, resolve
from roadloom.sources.csv import count_rows, output_name, read_kind, read_text_csv, read_typed_csv, write_csv

LMD = """TestDateUTC,Lane,RoadName,RoadID,location
2024-10-29T08:00:00.000Z,L1,M1 North A,101,1.20
2024-10-29T08:05:05.900Z,L1,M1 North A,101,1.30
2024-10-29T08:07:00.000Z,L2,M1 North B,101,2.00
2024-10-29T08:15:00.000Z,R1A,Ring,102,0.50
2024-10-29T08:25:00.000Z,1,Ring East,102,
2024-10-29T08:35:00.000Z,L1,Ring East,,0.55
2024-10-29T08:35:00.000Z,L1,Ring East,,0.55
2024-10-29T09:30:00.000Z,L3,M2 South,103,3.005
"""
FIXES = """From,To,Lane,Ignore,Plate
29/10/2024 08:00:00,29/10/2024 08:05:05,2,,P1
29/10/2024 08:04:00,29/10/2024 08:06:00,TURN,1,P1
29/10/2024 08:06:30,29/10/2024 08:20:00,-1,1,P1
29/10/2024 08:14:00,29/10/2024 08:16:00,3,0,P1
29/10/2024 08:20:00,29/10/2024 08:30:00,4,True,P1
"""
BRIEF = """RoadID,Start Chainage (km),End Chainage (km)
101,1.196,1.304
101,1.9,1.99
102,0.4,0.6
102,0.45,0.5
x,0,9
"""
ROADS = ["M1 North", "M1 North", "M1 North", "Ring", "Ring", "Ring", "Ring", "M2"]
BRIEFED = [True, True, False, True, False, False, False, False]
LANES = {
    FIRST_LISTED: [("L2", False), ("L2", False), ("L2", False), ("R1A", False), ("4", True), ("L1", False), ("L1", False), ("L3", False)],
    LATEST_START: [("L2", False), ("TURN", True), ("L2", True), ("R3A", False), ("4", True), ("L1", False), ("L1", False), ("L3", False)],
}


@pytest.fixture
def files(tmp_path):
    for name, text in (("lmd", LMD), ("fixes", FIXES), ("brief", BRIEF)):
        (tmp_path / f"{name}.csv").write_text(text)
    return [str(tmp_path / f"{n}.csv") for n in ("lmd", "fixes", "brief")]


@pytest.mark.parametrize("policy", [FIRST_LISTED, LATEST_START])
def test_golden(spark, files, tmp_path, policy):
    seen = []
    path, report = run_pipeline(spark, *files, out_path=str(tmp_path / "out"), policy=policy, progress=lambda m, p: seen.append(p), single=True)
    part = glob.glob(f"{path}/part-*.csv")
    lines = open(part[0]).read().splitlines()
    assert len(part) == 1 and lines[0] == "TestDateUTC,Lane,RoadName,RoadID,location,Ignore,InBrief"
    rows = [x.split(",") for x in lines[1:]]
    assert rows[0][0] == "29/10/2024 08:00:00.000" and rows[1][0] == "29/10/2024 08:05:05.900"
    assert [(r[1], r[5] == "True") for r in rows] == LANES[policy]
    assert [r[2] for r in rows] == ROADS and [r[6] == "True" for r in rows] == BRIEFED
    assert rows[4][4] == "" and rows[5][3] == ""
    assert report.counts["rows_in"] == report.counts["rows_out"] == 8 and report.counts["in_brief"] == 3 and report.counts["matched"] == 5
    assert seen[-1] == 100 and seen == sorted(seen)


def test_wrong_files(spark, files, tmp_path):
    with pytest.raises(SchemaError, match="combined_lmd"):
        read_kind(spark, files[0], "lane_fixes")
    with pytest.raises(SchemaError):
        run_pipeline(spark, files[1], files[0], files[2])
    (tmp_path / "noplate.csv").write_text("From,To,Lane,Ignore\n1,2,3,4\n")
    with pytest.raises(SchemaError):
        read_kind(spark, str(tmp_path / "noplate.csv"), "lane_fixes")
    assert read_kind(spark, str(tmp_path / "noplate.csv"), "lane_fixes", plate_required=False).count() == 1
    with pytest.raises(SchemaError):
        read_kind(spark, str(tmp_path / "x.xlsx"), "lane_fixes")
    df = spark.createDataFrame([("a",)], "x string")
    for step in (lambda: apply_lane_fixes(df, df), lambda: flag_in_brief(df, df)):
        with pytest.raises(SchemaError):
            step()


def test_the_steps_alone(spark, files, tmp_path):
    path, report = run_lane_fixes(spark, *files[:2], out_path=str(tmp_path / "f"), single=True)
    lines = open(glob.glob(f"{path}/part-*.csv")[0]).read().splitlines()
    assert len(lines) == 9 and lines[5] == "29/10/2024 08:25:00.000,4,Ring,102,,True" and report.counts["From_failures"] == 0
    path = run_brief(spark, files[0], files[2], out_path=str(tmp_path / "b"), single=True)
    lines = open(glob.glob(f"{path}/part-*.csv")[0]).read().splitlines()
    assert [x.rsplit(",", 1)[1] for x in lines[1:]] == [str(b) for b in BRIEFED] and lines[1].startswith("29/10/2024 08:00:00.000,L1,M1 North A,101,1.2")


def test_own_flags_and_strictness(spark):
    lmd = spark.createDataFrame([("2024-01-01T00:00:00Z", "L1", "A B", "yes"), ("2024-01-01T00:00:09Z", "L1", "A B", "T")], "TestDateUTC string, lane string, `Road Name` string, Ignore string")
    fixes = spark.createDataFrame([("2024-01-01 00:00:05", "2024-01-01 00:00:10", "-1", "0")], "From string, To string, Lane string, Ignore string")
    rows = apply_lane_fixes(lmd, fixes).collect()
    assert [(r["lane"], r["Ignore"]) for r in rows] == [("L1", False), ("L1", True)]
    table = spark.createDataFrame([("007", "5", "old"), ("7.0", "oops", "old"), (None, None, None)], "RoadID string, Chainage string, InBrief string")
    brief = spark.createDataFrame([("7", "0", "1")], "RoadID string, start_chainage string, end_chainage string")
    assert [r["InBrief"] for r in flag_in_brief(table, brief).collect()] == [True, False, False]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        flag_in_brief(table, brief, strict=True).collect()


def test_sources_and_sinks(spark, files, tmp_path):
    (tmp_path / "odd.csv").write_text('a,b\n"x ""q"", y",NA\n2,null\n')
    df = read_text_csv(spark, str(tmp_path / "odd.csv"))
    write_csv(df, str(tmp_path / "odd_out"), single=True)
    assert open(glob.glob(str(tmp_path / "odd_out/part-*"))[0]).read() == 'a,b\n"x ""q"", y",\n2,\n'
    assert count_rows(spark, files[0]) == 8
    assert dict(read_typed_csv(spark, files[2]).dtypes)["Start Chainage (km)"] == "double"
    assert output_name("/x/lmd.csv", "complete", datetime.date(2024, 1, 2)) == "/x/lmd_complete_20240102.csv"


def test_schema_rules():
    assert resolve(["lane", "Lane"], "Lane") == "Lane" and resolve(["x"], "Lane") is None
    assert file_kind(["From", "To", "Lane", "Ignore"]) == "unknown" and file_kind(["TestDateUTC"]) == "combined_lmd" and file_kind(["RoadName", "Lane"]) == "workbrief"
    assert file_kind(["RoadName", "Lane", *"abcdefghijklmnopqrs"]) == "unknown"
    assert missing_exact(["a"], ["a", "b"]) == ["b"] and missing_flexible(["lane"], ["Lane", "RoadName"]) == ["RoadName"]


def test_guard(spark, caplog):
    df = spark.range(5)
    assert guard_rows(df, 5, 5) is df and guard_rows(df, 3, 5).count() == 3 and guard_rows(df, 9, 5) is df and "only 5 of 9" in caplog.text
