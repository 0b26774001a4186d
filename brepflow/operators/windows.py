"""Ordered analytics over logs of one run or many (W family)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stretch(order: Column, steps: int = 1 << 16) -> Column:
    """The part of a run in which a row lies: stretches of so many steps of a whole-number order column."""
    return F.floor(order / steps)


def _opening(sums: DataFrame, run: str, columns: list[str]) -> DataFrame:
    """Of each part, the sums over the parts of its run before it: a row for each part is all that a run puts together."""
    before = Window.partitionBy(run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col(run).alias("_run"), F.col("_part").alias("_of"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in columns))


def _with_opening(cut: DataFrame, opening: DataFrame, run: str) -> DataFrame:
    return cut.join(opening, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_part") == F.col("_of"))).drop("_run", "_of")


def trailing_mean(log: DataFrame, run: str, order: list[str], part: Column, value: str, width: int = 100, block: int = 1 << 16) -> DataFrame:
    """The log with ``mean`` over the last ``width`` rows; a shorter prefix counts as it is.

    ``part`` cuts a run along its order. Rows are numbered by parts; blocks of ``block`` rows then get the last
    ``width - 1`` rows of the block before them, so no task orders a whole run.
    """
    if block < width:
        raise ValueError("a block must hold a window")
    cut = log.withColumn("_part", part)
    opening = _opening(cut.groupBy(run, "_part").agg(F.count("*").alias("n")), run, ["n"])
    number = F.row_number().over(Window.partitionBy(run, "_part").orderBy(*order)) - 1
    numbered = _with_opening(cut.withColumn("_i", number), opening, run).withColumn("_i", F.col("_i") + F.col("_before_n"))
    own, late = F.floor(F.col("_i") / block), F.pmod("_i", F.lit(block)) > block - width
    lent = numbered.withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    by = Window.partitionBy(run, "_block").orderBy("_i").rowsBetween(-(width - 1), 0)
    means = lent.withColumn("mean", F.round(F.avg(value).over(by), 8))
    return means.filter(F.col("_block") == own).drop("_part", "_i", "_before_n", "_block")


def running_rate(log: DataFrame, run: str, order: list[str], part: Column, holds: Column) -> DataFrame:
    """The log with ``rate``, the share of rows so far that hold: sums of parts, then sums within a part."""
    cut = log.withColumns({"_part": part, "_c": holds.cast("int"), "_one": F.lit(1)})
    opening = _opening(cut.groupBy(run, "_part").agg(F.sum("_c").alias("c"), F.sum("_one").alias("n")), run, ["c", "n"])
    inside = Window.partitionBy(run, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rate = (F.col("_before_c") + F.sum("_c").over(inside)) / (F.col("_before_n") + F.sum("_one").over(inside))
    return _with_opening(cut, opening, run).withColumn("rate", F.round(rate, 6)).drop("_part", "_c", "_one", "_before_c", "_before_n")


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running medians over rows sorted by run and order, with two heaps for the run at hand."""
    low: list[float] = []
    high: list[float] = []
    now: object = _medians  # no run yet
    for batch in batches:
        out: list[float | None] = []
        for run, x in zip(batch.column("run").to_pylist(), batch.column("x").to_pylist()):
            if run != now:
                now, low, high = run, [], []
            if x is not None:
                heapq.heappush(high, -heapq.heappushpop(low, -x))
                if len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
            out.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
        yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("idx"), pa.array(out, pa.float64())], ["run", "idx", "median"])


def running_medians(log: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """(run, idx, median) of the values up to each row; null until there is one.

    A window's percentile would sort each prefix again. Rows stream through a worker in order,
    which keeps one run's values in two heaps; nulls are no values.
    """
    kinds = dict(log.dtypes)
    rows = log.select(F.col(run).alias("run"), F.col(order).alias("idx"), F.col(value).cast("double").alias("x"))
    return rows.repartition("run").sortWithinPartitions("run", "idx").mapInArrow(_medians, f"run {kinds[run]}, idx {kinds[order]}, median double")


def zero_streaks(log: DataFrame, run: str, order: str, part: Column, counts: Column, resets: Column, warn: int, fatal: int) -> DataFrame:
    """The streak at each row, and the rows that warn (exactly at ``warn``) or are fatal (from ``fatal`` on).

    Rows that neither count nor reset are kept with the streak as it stands. A run is cut into parts; a part without a
    reset hands the streak before it on, with its own counts added, so a run's parts need one row each.
    """
    cut = log.withColumns({"_part": part, "_c": F.coalesce(counts.cast("int"), F.lit(0)), "_r": F.coalesce(resets.cast("int"), F.lit(0))})
    inside = Window.partitionBy(run, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_island", F.sum("_r").over(inside))
    of_island = Window.partitionBy(run, "_part", "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_streak", F.sum("_c").over(of_island))
    ends = cut.groupBy(run, "_part").agg(F.max("_island").alias("resets"), F.max_by("_streak", order).alias("tail"))
    so_far = Window.partitionBy(run).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    # parts since the last one that resets: its tail, and all counts of the parts after it
    group = F.sum((F.col("resets") > 0).cast("int")).over(so_far)
    since = Window.partitionBy(run, "_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    after = ends.withColumn("_group", group).withColumn("after", F.sum("tail").over(since))
    opening = after.select(F.col(run).alias("_run"), F.col("_part").alias("_of"), F.coalesce(F.lag("after").over(Window.partitionBy(run).orderBy("_part")), F.lit(0)).alias("_before"))
    streak = F.col("_streak") + F.when(F.col("_island") == 0, F.col("_before")).otherwise(0)
    out = _with_opening(cut, opening, run).withColumn("streak", streak).drop("_part", "_c", "_r", "_island", "_streak", "_before")
    level = F.when(~F.coalesce(counts, F.lit(False)), "none").when(F.col("streak") >= fatal, "fatal").when(F.col("streak") == warn, "warn").otherwise("none")
    return out.withColumn("alarm", level)


def latest_checkpoint(paths: DataFrame, run: str, path: str) -> DataFrame:
    """The path with the greatest numeric suffix."""
    step = F.regexp_extract(path, r"-(\d+)$", 1).try_cast("bigint")
    return paths.withColumn("_s", step).filter("_s is not null").groupBy(run).agg(F.max_by(path, "_s").alias("latest"), F.max("_s").alias("step"))
