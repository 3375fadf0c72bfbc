from roadloom.plans.catalogue import QUERIES

TEXTS = {"10684.1": 10684.1, " 12 ": 12.0, "-.5e2": -50.0, "5.": 5.0, "22652.6 m": None, "22,370.4": None, "1d": None, "1f": None, "NaN": None, "inf": None, "": None, "NA": None, "5\n6": None, None: None}


def test_every_row_comes_out(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "lmd_id bigint, Chainage string").write.parquet(f"{tmp_path}/combined_lmd.parquet")
    got = {r["lmd_id"]: r["chainage"] for r in QUERIES["number_coerce_all"](spark, str(tmp_path)).collect()}
    assert got == {i: TEXTS[text] for i, text in rows}
