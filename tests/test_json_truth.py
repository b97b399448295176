"""Only whole JSON values count as JSON; types are tested, not first characters; files are told by their metadata."""

import os

import pytest

from segmentry.operators import evidence as E
from segmentry.sources import tables


@pytest.mark.parametrize("text,status", [
    ('x {"a":1} y {"b":2}', "invalid_json"), ('{"a":1},{"b":2}', "invalid_json"), ('{"a":1,}', "invalid_json"),
    ('{"a":1}] , [{"b":2}', "invalid_json"), ('see {"a":1} end', "ok"), ("[1]", "not_an_object"), ("", "empty")])
def test_replies(spark, text, status):
    reply = spark.createDataFrame([(text,)], "t string").selectExpr("to_json(named_struct('response', t)) AS reply")
    assert E.classify_replies(reply).first()["status"] == status


@pytest.mark.parametrize("body,status", [
    ('{"success":true,"concept":{"a":1}} junk', "non_json"), ('{"success":true,"concept":"{\\"title\\":1}"}', "unexpected"),
    ('{"success":true,"concept":{"a":1}}', "ok"), (None, "non_json")])
def test_service_bodies(spark, body, status):
    df = spark.createDataFrame([(body, 200)], "body string, http_status int")
    assert E.service_results(df).first()["status"] == status


@pytest.mark.parametrize("name,games,valid", [
    ('"n"', "[]", True), ('"n"', '"[x"', False), ("0", "[]", False), ("false", "[]", False), ('""', "[]", False),
    ("null", "[]", False), ("7", "[]", True), ("{}", "[]", True)])
def test_requests(spark, name, games, valid):
    body = f'{{"cluster_name":{name},"representative_games":{games},"keywords":["k"]}}'
    out = E.validate_requests(spark.createDataFrame([(body,), (body + "}",)], "payload string")).collect()
    assert [r["is_valid"] for r in out] == [valid, False] and out[1]["error"] == E.INVALID_BODY


def test_newest_file_may_hold_a_header_only(spark, tmp_path):
    for name, text, at in (("a.csv", "x\n1\n", 1_000), ("b.csv", "x\n", 2_000)):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (at, at))
    assert tables.latest_file(spark, str(tmp_path), header=True).count() == 0
    os.utime(tmp_path / "a.csv", (3_000, 3_000))
    assert [r[0] for r in tables.latest_file(spark, str(tmp_path), header=True).collect()] == ["1"]


def test_tolerant_read(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("no parquet")
    (tmp_path / "good.csv").write_text("a,b\n1,x\n")
    assert tables.read_or_empty(spark, str(tmp_path / "bad.parquet"), "a int").columns == ["a"]
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    assert [tuple(r) for r in tables.read_or_empty(spark, str(tmp_path / "good.csv"), "a int, b string", csv=True).collect()] == [(1, "x")]


def test_repeated_lookups_do_not_double_charts(spark):
    charts = spark.createDataFrame([("1", 1)], "app_id string, chart_position int")
    lookups = spark.createDataFrame([("1", "d"), ("1", "d")], "app_id string, description string")
    assert tables.enrich(charts, tables.unique_metadata(lookups)).count() == 1
    with pytest.raises(ValueError):
        tables.enrich(charts, lookups)
