import pytest

from roadloom.sources.csv import MissingFileError, count_rows, read_kind, read_text_csv, read_typed_csv, write_csv, write_csv_file


def test_line_breaks_and_blanks_come_back(spark, tmp_path):
    rows = [(1, 'one\ntwo "x", y'), (2, " blanks \r"), (3, "a\r\nb"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id int, v string")
    write_csv(df, str(tmp_path / "out"))
    back = read_text_csv(spark, str(tmp_path / "out"))
    assert {int(r["id"]): r["v"] for r in back.collect()} == {1: 'one\ntwo "x", y', 2: " blanks \r", 3: "a\r\nb", 4: None, 5: None}
    assert count_rows(spark, str(tmp_path / "out")) == 5 and read_typed_csv(spark, str(tmp_path / "out")).count() == 5


def test_one_file_of_a_given_name(spark, tmp_path):
    path = tmp_path / "result.csv"
    for n in (3, 2):  # the second replaces the first
        write_csv_file(spark.range(n), str(path))
        assert path.is_file() and path.read_text() == "id\n" + "".join(f"{i}\n" for i in range(n))
    assert not (tmp_path / "result.csv.parts").exists()


def test_missing_files_are_typed_errors(spark, tmp_path):
    gone = str(tmp_path / "gone.csv")
    for read in (read_text_csv, read_typed_csv, count_rows):
        with pytest.raises(MissingFileError):
            read(spark, gone)
    with pytest.raises(MissingFileError):
        read_kind(spark, gone, "lane_fixes")
