"""Stages that are deleted, and files that are neither lost nor changed on their way."""

import os

import pytest

from brepflow import session
from brepflow.sources import files


def shared(spark) -> str:
    return session.shared_folder(spark).removeprefix("file://")


def test_stages_are_deleted(spark):
    session.clear_stages(spark)
    before = set(os.listdir(shared(spark)))
    t = spark.range(10)
    with session.stages(spark):
        inner = session.stage(t, "inner")
        assert session.stage(inner, "next", instead_of=inner).count() == 10
        os.makedirs(session.scratch(spark, "files"))
    assert set(os.listdir(shared(spark))) == before
    session.stage(t, "left")
    session.clear_stages(spark)
    assert set(os.listdir(shared(spark))) == before


def test_files_of_any_name_and_none_lost(spark, tmp_path):
    rows = [("a b+c%.step", "DATA;\r\n#1=A();\n"), ("x/0000_2.step", ""), ("x/ü_3.step", None), ("x/y/0000_4.step", "ü€\n")]
    files.write_steps(spark.createDataFrame(rows, "rel_path string, text string"), str(tmp_path / "s"))
    back = files.read_steps(spark, str(tmp_path / "s"), recursive=True).collect()
    assert sorted((r.rel_path, r.text) for r in back) == sorted((p, t or "") for p, t in rows)
    assert {r.uid for r in back} >= {"0000/2", "0000/4", "ü/3"}
    assert [r.rel_path for r in files.read_steps(spark, str(tmp_path / "s")).collect()] == ["a b+c%.step"]


def test_latin_1_where_utf_8_fails(spark, tmp_path):
    (tmp_path / "a.step").write_bytes("#1=A('ü');".encode("latin-1"))
    assert files.read_steps(spark, str(tmp_path)).first().text == "#1=A('ü');"


def test_files_that_are_there_can_be_left(spark, tmp_path):
    one = lambda text: spark.createDataFrame([("a.step", text)], "rel_path string, text string")
    files.write_steps(one("old"), str(tmp_path))
    files.write_steps(one("new"), str(tmp_path), skip_existing=True)
    assert (tmp_path / "a.step").read_text() == "old"
    files.write_steps(one("new"), str(tmp_path))
    assert (tmp_path / "a.step").read_text() == "new" and os.listdir(tmp_path) == ["a.step"]


def test_arrays_keep_nulls_and_order(spark, tmp_path):
    t = spark.createDataFrame([(2, None), (1, 'a"\n')], "id int, x string")
    assert files.write_json_array(t, str(tmp_path / "a.json"), "id") == 2
    import json

    assert json.loads((tmp_path / "a.json").read_text()) == [{"id": 1, "x": 'a"\n'}, {"id": 2, "x": None}]
    assert files.write_json_array(t.limit(0), str(tmp_path / "b.json"), "id") == 0
    assert json.loads((tmp_path / "b.json").read_text()) == []


@pytest.mark.parametrize("path, uid", [("p/0001/q/r/x.pth", "0001/x"), ("r/x.pth", "x"), ("x", "x")])
def test_uid_of_a_path(spark, path, uid):
    from pyspark.sql import functions as F

    assert spark.range(1).select(files.path_uid(F.lit(path)).alias("u")).first().u == uid
