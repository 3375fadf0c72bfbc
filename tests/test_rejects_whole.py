from roadloom.operators.rejects import Bulk, Layout, parse_mixed, parse_records, whole_records

SCHEMA = "line_id bigint, file_name string, kind string, line_no int, record_text string"
T = "2024-10-29T00:20:36.103Z"


def test_every_column_loads(spark):
    rows = [
        (1, "a", "lmd", 1, "Test Date UTC,Road_ID,lane,Chainage,tsdSlope2000,Weather"), (2, "a", "lmd", 2, f'{T},R7,L1,"22,370.4", 5.5 ,"wet, cold"'),
        (3, "b", "fixes", 1, "start_time,To,Lane,skip,Plate,Note,Note,LANE"), (4, "b", "fixes", 2, f"{T},{T},L2,1,P1,x,y,L3"), (5, "b", "fixes", 3, f"{T},{T},L2,1,P1,x,y"),
        (6, "c", "lmd", 1, "TestDateUTC,lane,Lane"), (7, "c", "lmd", 2, f"{T},L1,NA"),
    ]
    got = {r["line_id"]: r for r in whole_records(parse_records(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert sorted(got) == [2, 4, 7]
    a, b, c = got[2], got[4], got[7]
    assert (a["TestDateUTC"], a["RoadID"], a["Lane"], a["Chainage"], a["tsdSlope2000"], a["others"]) == (T, "R7", "L1", "22,370.4", " 5.5 ", {"Weather": "wet, cold"})
    assert (b["From"], b["To"], b["Lane"], b["Ignore"], b["Plate"], b["others"]) == (T, T, "L2", "1", "P1", {"Note": "x", "Note (2)": "y", "LANE": "L3"})
    assert (c["Lane"], c["others"], c["RoadID"]) == ("NA", {"lane": "L1"}, None)


def test_most_valid_records_load_in_bulk():
    layout = Layout("TestDateUTC,Lane,RoadName,Plate", "lmd")
    good = [f'{T},L{i % 9 + 1},"Road, {i}",P' if i % 3 else f"29/02/2024 0:00:0{i % 10},L1,Road {i},P" for i in range(400)]
    bad = ["x", f"{T},L0,Road,P", f'{T},"L1,Road,P', ""]
    records = [r for i, g in enumerate(good) for r in ([g, bad[i % 4]] if i % 7 == 0 else [g])]
    bulk = Bulk([layout] * len(records), records)
    valid = [i for i, r in enumerate(records) if layout.diagnose(r)[0] is None]
    certain = [i for i in valid if bulk.clean(i, i + 1)]
    assert len(certain) > 0.6 * len(valid) and all(bulk.fields[i] == layout.diagnose(records[i])[1] for i in certain)
    assert not any(bulk.clean(i, i + 1) for i in set(range(len(records))) - set(valid))


def test_records_of_different_layouts_in_one_block():
    layouts = [Layout("TestDateUTC,Lane", "lmd"), Layout("From,To,Ignore", "fixes"), Layout(None, "lmd"), Layout("a", "other")]
    records = [f"{T},L1", f"{T},{T},t", f"{T},L1", "x", f"{T},{T},t", f"{T},L1,", "", "NA", f"{T},XX", f"{T},{T},maybe", "", "y,z"]
    mixed = [layouts[i % 4] for i in range(len(records))]
    assert parse_mixed(mixed, records) == [x.diagnose(r) for x, r in zip(mixed, records)]
