from test_clocks import FILES, LOADED, ROWS, read

from roadloom.operators.clocks import all_zones, distinct_histories, with_instants


def test_no_zone_is_named_anywhere(spark):
    """Candidates are the JVM's own zones then: the marked times of the file settle the offset, over a clock change too."""
    rows = []
    for day in ("2024-03-09", "2024-03-11"):  # the clocks of New York go forward on the 10th
        off = 5 if day < "2024-03-10" else 4
        for h in range(0, 12, 2):
            rows += [("x", f"{day}T{h + off:02d}:00:00Z"), ("x", f"{day} {h:02d}:05:00")]
    got = read(spark, rows, [("x", None, "DMY", None)])
    assert [g for (_, v), g in zip(rows, got) if "Z" not in v] == [f"{v[:10]}T{int(v[11:13]) + (5 if v < '2024-03-10' else 4):02d}:05:00.000000Z" for _, v in rows if "Z" not in v]


def test_histories_are_taken_once(spark):
    found = distinct_histories(spark, 1_700_000_000_000_000, 1_720_000_000_000_000, ["Europe/Madrid"])
    assert "Europe/Madrid" in found and "Europe/Berlin" not in found and "Africa/Abidjan" in found
    assert 30 < len(found) < len(all_zones(spark))


def test_marks_of_zones_that_are_not_listed(spark):
    files = [("h", "Pacific/Honolulu", "DMY", LOADED), ("z", "nowhere", "DMY", LOADED)]
    got = read(spark, [("h", "2024-07-01 05:00:00 HST"), ("h", "2024-07-01 05:00:00 CEST"), ("h", "2024-07-01 05:00:00 GMT"), ("z", "2024-07-01 05:00:00Z")], files)
    assert got == ["2024-07-01T15:00:00.000000Z", "unreadable", "2024-07-01T05:00:00.000000Z", "2024-07-01T05:00:00.000000Z"]


def test_repeated_files_and_null_names(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", LOADED), (2, None, "2024-01-01 00:00:00", LOADED), (3, "a", None, None)], ROWS)
    files = spark.createDataFrame([("a", None, None, None), ("a", "UTC", "DMY", None), (None, "UTC", "DMY", None)], FILES)
    rows = {r["id"]: (r["v_us"], r["v_word"]) for r in with_instants(df, files, ["v"]).collect()}
    assert rows == {1: (1_704_067_200_000_000, None), 2: (None, "no zone"), 3: (None, None)}
