import os

import pytest
from test_pipeline import files  # noqa: F401

from roadloom.plans import pipeline


def test_a_wrong_number_of_rows_is_never_published(spark, files, tmp_path, monkeypatch):  # noqa: F811
    out = str(tmp_path / "out")
    pipeline.run_pipeline(spark, *files[:3], out_path=out)
    before = sorted(os.listdir(out))
    plain = pipeline.flag_in_brief
    monkeypatch.setattr(pipeline, "flag_in_brief", lambda *a, **k: plain(*a, **k).unionByName(plain(*a, **k).limit(1)))
    with pytest.raises(pipeline.RowCountError):
        pipeline.run_pipeline(spark, *files[:3], out_path=out)
    assert sorted(os.listdir(out)) == before and not os.path.exists(f"{out}.unchecked")
