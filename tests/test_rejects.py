import random

import pytest

from roadloom.operators.rejects import Layout, is_real_time, loaded_records, parse_block, parse_records, rejected_records, split_strictly

LMD = "TestDateUTC,Lane,RoadName,Plate"
FIX = "From,To,Lane,Ignore,Plate"
SCHEMA = "line_id bigint, file_name string, kind string, line_no int, record_text string, reason string, fields int"
T = "2024-10-29T00:20:36.103Z"


@pytest.mark.parametrize(
    ("kind", "record", "reason"),
    [
        ("lmd", f"{T},L1,Road,P1", None), ("lmd", f'"{T}","L1","a ""b"", c\nd","P1"\r', None), ("lmd", "NA,,null,NULL", None),
        ("lmd", f'{T},L1,Ro"ad,P1', "quoting"), ("lmd", f'{T},L1,"Road" x,P1', "quoting"), ("lmd", f'{T},L1,Road,"P1', "quoting"), ("lmd", f'{T},L1, "Road",P1', "quoting"),
        ("lmd", f"{T},L1,Road", "columns"), ("lmd", f"{T},L1,Road,P1,", "columns"), ("lmd", "", "columns"), ("lmd", None, "columns"), ("lmd", f'{T},"L1,"Road,P1', "quoting"),
        ("lmd", "2024-02-30T00:20:36Z,L1,Road,P1", "timestamp"), ("lmd", "10/29/2024 00:20:36,L1,Road,P1", "timestamp"), ("lmd", "yesterday,L0,Road,P1", "timestamp"),
        ("lmd", f"{T},L0,Road,P1", "lane"), ("lmd", f"{T},L10,Road,P1", "lane"), ("lmd", f"{T}, R3B ,Road,P1", None), ("lmd", f"{T},r1,Road,P1", "lane"), ("lmd", f"{T},4C,Road,P1", None),
        ("fixes", f"{T},{T},TURN,1,P1", None), ("fixes", f"{T},{T},TURN,yes,P1", "ignore"), ("fixes", f"{T},29/02/2023 01:00:00,TURN,yes,P1", "timestamp"),
        ("fixes", "1635465636.5,1635465636103,x, t ,P1", None), ("other", "a,b,c,d", None),
    ],
)
def test_reasons(kind, record, reason):
    layout = Layout(FIX if kind == "fixes" else LMD, kind)
    text = (record or "").removesuffix("\r")
    assert layout.diagnose(text)[0] == reason
    assert [r for r, _ in parse_block(layout, [text] * 20)] == [reason] * 20


@pytest.mark.parametrize("text", ["2024-02-29T01:02:03", "29/02/2024 1:02:03.5", "2024-10-29 0:20:36", "2024-10-29T00:20:36.1+02:00", "2024-10-29T00:20:36+0930"])
def test_real_times(text):
    assert is_real_time(text)


@pytest.mark.parametrize("text", ["2023-02-29T01:02:03", "2024-10-29", "29/10/24 00:00:00", "2024-10-29T25:20:36Z", "2024-10-29T00:20:36+19:00", "1635465", "29-10-2024 00:00:00", "٢٠٢٤-10-29 0:20:36"])
def test_no_times(text):
    assert not is_real_time(text)


def test_bulk_agrees_with_strict():
    rng = random.Random(1)
    pieces = ['"', ",", "\n", " ", "L1", T, "a", "NA", '""', "31/02/2024 00:00:00", "9"]
    layout = Layout(LMD, "lmd")
    records = [f"{T},L{rng.randrange(1, 10)},Road {i},P" if rng.random() < 0.7 else "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for i in range(3000)]
    assert parse_block(layout, records) == [layout.diagnose(r) for r in records]


def test_split():
    assert split_strictly('a,"b ""c"", d",') == ["a", 'b "c", d', ""] and split_strictly("") == [""] and split_strictly('"') is None and split_strictly('"a"b') is None


def test_table(spark):
    rows = [(1, "f", "lmd", 1, LMD, "x", 1), (2, "f", "lmd", 2, f"{T},L1,Road,P1", "x", 1), (2, "f", "lmd", 2, f"{T},L1,Road,P1", "x", 1), (3, "f", "lmd", 3, "x" * 300_000, "x", 1),
            (4, "f", "lmd", 4, None, "x", 1), (5, "lost", "lmd", 2, "a,b", "x", 1), (6, None, None, None, "a", "x", 1), (7, "f", "lmd", 1, "a,b", "x", 1), (8, "f", "lmd", 9, f"{T},??,Road,P1", "x", 1)]
    parsed = parse_records(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, rejected_records(parsed).collect())) == [(3, "columns"), (4, "columns"), (5, "columns"), (6, "columns"), (8, "lane")]
    assert [tuple(r) for r in loaded_records(parsed, "lmd", ["Lane", "Nope"]).collect()] == [(2, "f", 2, "L1", None)] * 2
    assert parse_records(spark.createDataFrame([], SCHEMA)).count() == 0
