"""Running sums, windows and quantiles cut into parts equal those of whole runs."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from brepflow.operators import metrics, windows


def log(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), i, rnd.choice([None, 0.0, round(rnd.random(), 3)])) for i in range(n) if rnd.random() < 0.7]
    return spark.createDataFrame(rows, "run string, i int, x double"), rows


def runs(rows):
    out = {}
    for run, i, x in rows:
        out.setdefault(run, []).append((i, x))
    return out


@pytest.mark.parametrize("steps", [1, 7, 1000])
def test_trailing_means_and_rates(spark, steps):
    t, rows = log(spark)
    part = windows.stretch(F.col("i"), steps)
    means = {(r.run, r.i): r["mean"] for r in windows.trailing_mean(t, "run", ["i"], part, "x", 5, 8).collect()}
    rates = {(r.run, r.i): r.rate for r in windows.running_rate(t, "run", ["i"], part, F.col("x").isNotNull()).collect()}
    assert len(means) == len(rates) == len(rows)
    for run, values in runs(rows).items():
        for k, (i, _) in enumerate(values):
            last = [x for _, x in values[max(0, k - 4) : k + 1] if x is not None]
            assert means[run, i] == (pytest.approx(sum(last) / len(last), abs=1e-8) if last else None)
            assert rates[run, i] == pytest.approx(sum(x is not None for _, x in values[: k + 1]) / (k + 1), abs=1e-6)
    with pytest.raises(ValueError):
        windows.trailing_mean(t, "run", ["i"], part, "x", 9, 8)


@pytest.mark.parametrize("steps", [1, 7, 1000])
def test_streaks(spark, steps):
    t, rows = log(spark, seed=2)
    found = windows.zero_streaks(t, "run", "i", windows.stretch(F.col("i"), steps), F.col("x") == 0, F.coalesce(F.col("x") > 0.6, F.lit(False)), 2, 3)
    got = {(r.run, r.i): (r.streak, r.alarm) for r in found.collect()}
    for run, values in runs(rows).items():
        streak = 0
        for i, x in values:
            streak = 0 if x is not None and x > 0.6 else streak + (x == 0)
            level = "none" if x != 0 else "fatal" if streak >= 3 else "warn" if streak == 2 else "none"
            assert got[run, i] == (streak, level)


def test_quantiles_of_groups(spark):
    t, rows = log(spark, 600, 3)
    found = {r.run: r for r in metrics.group_quantiles(t.repartition(6), "run", "x", {"m": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}).collect()}
    for run, values in runs(rows).items():
        xs = [x for _, x in values if x is not None]
        assert found[run].m == pytest.approx(statistics.median(xs)) and found[run].p90 == pytest.approx(np.percentile(xs, 90))
        assert (found[run].p0, found[run].p100) == (min(xs), max(xs))
    assert metrics.group_quantiles(t.filter("x is null"), "run", "x", {"m": 0.5}).count() == 0


def test_floor_quantiles_of_doubles(spark):
    t, rows = log(spark, 500, 4)
    xs = sorted(x for _, _, x in rows if x is not None)
    found = metrics.floor_quantiles(t, "x", {"p25": (1, 4), "m": (1, 2), "p99": (99, 100)}).first()
    assert tuple(found) == tuple(xs[len(xs) * a // b] for a, b in ((1, 4), (1, 2), (99, 100)))


def test_bundle_of_no_rows(spark):
    t = spark.createDataFrame([(1.0, True, 3), (float("inf"), False, 5), (None, None, None)], "scd double, ok boolean, n int")
    parts = {"all": F.lit(True), "none": F.lit(False)}
    got = {r.part: (r.n, r.cr, r.rr, r.mscd, r.aec) for r in metrics.bundle(t, F.col("ok"), F.col("scd"), F.col("n"), parts).collect()}
    assert got == {"all": (3, 0.5, 0.666667, 1.0, 4.0), "none": (0, 0.0, 0.0, float("inf"), 0.0)}
