from test_clocks import LOADED, read

SYDNEY = [("known", "Australia/Sydney", "DMY", None), ("other", "Europe/London", "DMY", None)]
ROWS = [("x", "2024-05-31T02:00:00Z"), ("x", "2024-05-31 12:05:00"), ("x", "2024-05-31T02:10:00Z"), ("x", "2024-05-31 12:15:00")]


def test_zone_of_a_file_that_is_not_listed(spark):
    assert read(spark, ROWS, SYDNEY)[1] == "2024-05-31T02:05:00.000000Z"


def test_order_of_a_file_that_is_not_listed(spark):
    got = read(spark, [("m", "03/04/2024 01:00:00"), ("m", "03/25/2024 01:00:00"), (None, "03/25/2024 01:00:00Z")], [("known", "UTC", "DMY", LOADED)])
    assert got == ["2024-03-04T01:00:00.000000Z", "2024-03-25T01:00:00.000000Z", "unreadable"]


def test_no_zone_known_at_all(spark):
    for files in ([], [("x", None, "DMY", None)]):
        got = read(spark, [("x", "2024-07-01T05:00:00Z"), ("x", "2024-07-01 06:00:00"), ("x", "2024-07-01 06:00:00 BST")], files)
        assert got[1].startswith("2024-07-01T") and got[1] != "no zone"
