"""Scoring of texts as one chain, STL files, cached rows."""

import math
import struct

import numpy as np
import pytest

from brepflow.operators import geometry as R
from brepflow.operators import tokens
from brepflow.session import scratch


def text(points, end="END-ISO-10303-21;"):
    return "DATA;\n" + "\n".join(f"#{i}=CARTESIAN_POINT('',({x},{y},{z}));" for i, (x, y, z) in enumerate(points, 1)) + f"\nENDSEC;\n{end}"


def test_chain_of_scores(spark):
    rng = np.random.default_rng(3)
    a = rng.random((40, 3)).round(6)
    turn = np.array([[math.cos(0.2), -math.sin(0.2), 0], [math.sin(0.2), math.cos(0.2), 0], [0, 0, 1]])
    rows = [
        (1, text(a), text(a)), (2, text((2 * a @ turn.T + 5).round(9)), text(a)), (3, text(a, ""), text(a)), (4, text([]), text(a)), (5, text(a[:3]), text(a)),
        (6, text(a), ""), (7, text(a), text(a[:4])), (8, None, text(a)), (9, text(a), None),
    ]
    t = spark.createDataFrame([(*r, "clash") for r in rows], "id bigint, pred string, gt string, text string")
    got = {r.id: r for r in R.scored_texts(t, R.point_fan, R.RewardConfig(n_points=200)).collect()}
    assert [got[i].stage for i in range(1, 10)] == ["ok", "ok", "no_terminator", "pred_parse", "pred_degenerate", "gt_parse", "gt_degenerate", "no_terminator", "gt_parse"]
    assert got[1].scd == 0 and got[1].reward == 1 and got[1].parse == 0.3 and got[1].n_triangles == 38
    assert got[2].scd < 0.5 and got[2].reward > 0  # other samples of a turned, larger copy
    assert got[3].reward == 0 and math.isnan(got[6].reward) and got[4].parse == 0
    missing = R.scored_texts(t, None).collect()
    assert {r.stage for r in missing if r.id in (1, 2)} == {"pred_parse"}
    assert R.scored_texts(t.limit(0), R.point_fan).count() == 0


def test_stl(spark):
    t = spark.createDataFrame([(1, [[[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]]), (2, []), (3, None)], "id bigint, triangles array<array<array<double>>>")
    got = {r.id: r.stl for r in R.stl(t).collect()}
    assert len(got[1]) == 134 and struct.unpack("<I", got[1][80:84]) == (1,) and struct.unpack("<3f", got[1][84:96]) == (0, 0, 1)
    assert len(got[2]) == 84 and got[3] is None


def test_formatted_rows_are_made_once_and_anew_after_a_failure(spark):
    base, calls = scratch(spark, "formatted"), []

    def make():
        calls.append(1)
        return spark.range(3)

    assert tokens.formatted(spark, base, ("a",), make)[1] is False
    rows, reused = tokens.formatted(spark, base, ("a",), make)
    assert reused and rows.count() == 3 and len(calls) == 1
    path = spark._jvm.org.apache.hadoop.fs.Path(rows.inputFiles()[0]).getParent()
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"), False)
    assert tokens.formatted(spark, base, ("a",), make)[1] is False and len(calls) == 2


def test_limits_of_a_configuration():
    assert R.RewardConfig().delta_high == pytest.approx(0.5)
    with pytest.raises(Exception):
        R.RewardConfig().n_points = 3
