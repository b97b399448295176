"""Scratch folder: taken from the session, local fallback, refused on a cluster."""

from types import SimpleNamespace

import pytest

from segmentry.session import materialize, scratch_path, scratch_root


def fake(master, folder):
    context = SimpleNamespace(master=master, applicationId="app-1")
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder or default))


def test_scratch_folder():
    assert scratch_root(fake("spark://host", "hdfs://shared/tmp/")) == "hdfs://shared/tmp"
    local = scratch_root(fake("local[2]", None))
    assert local == scratch_root(fake("local[2]", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(fake("spark://host", None))


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "array(id) as a")
    out = materialize(df, "check")
    assert out.dtypes == df.dtypes and sorted(r["id"] for r in out.collect()) == [0, 1, 2, 3, 4]
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
