"""Quantiles and rates in the three conventions in use (A family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brepflow.session import stage


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def rate(x: Column) -> Column:
    """The share of rows that hold; null over no rows."""
    return F.round(F.avg(x.cast("int")), 6)


def median_finite(x: Column) -> Column:
    """Median over finite values; infinite if there is none."""
    return F.coalesce(F.median(F.when(finite(x), x)), F.lit(float("inf")))


def bundle(rows: DataFrame, complete: Column, scd: Column, entities: Column, parts: dict[str, Column]) -> DataFrame:
    """(part, n, cr, rr, mscd, aec) for each part of the rows: rates and means in one pass, the medians by ``group_quantiles``.

    A part without rows has zeros, and an infinite median as one without finite values has.
    """
    agg = []
    for k, (name, holds) in enumerate(parts.items()):
        share = lambda x: F.coalesce(F.round(F.avg(F.when(holds, x)), 6), F.lit(0.0))  # noqa: B023, E731
        row = (F.lit(name).alias("part"), F.count_if(holds).alias("n"), share(complete.cast("int")).alias("cr"), share(scd.isNotNull().cast("int")).alias("rr"), share(entities).alias("aec"))
        agg.append(F.struct(*row).alias(f"p{k}"))
    plain = rows.agg(*agg).select(F.explode(F.array(*(f"p{k}" for k in range(len(parts))))).alias("p")).select("p.*")
    of = F.explode(F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in parts.items())))).alias("part")
    medians = group_quantiles(rows.select(of, F.when(finite(scd), scd).alias("_scd")), "part", "_scd", {"mscd": 0.5})
    return plain.join(medians, "part", "left").withColumn("mscd", F.round(F.coalesce("mscd", F.lit(float("inf"))), 6))


def percentile(x: Column, p: float) -> Column:
    """Linear between neighbours."""
    return F.round(F.percentile(x, F.lit(p)), 6)


def _ranged(counted: DataFrame, value: str) -> DataFrame:
    """Distinct values with their counts in ranges: (value, c, range), written once so that ranges stay what they are."""
    ranged = counted.repartitionByRange(value).withColumn("range", F.spark_partition_id())
    return stage(ranged, "value-ranges")


def floor_quantiles(rows: DataFrame, value: str, places: dict[str, tuple[int, int]]) -> DataFrame:
    """Values at index ``n * num // den`` of the sorted rows, by name.

    Equal values are counted first. Distinct values are cut into sorted ranges; the ranges' counts are summed up (a row a
    range), and only within a range are values ordered: no task sees all of them.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    ranged = _ranged(counted, value)
    sizes = ranged.groupBy("range").agg(F.sum("c").alias("n"))
    every = sizes.agg(F.sum("n").alias("total"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = every.first()["total"] or 0
    inside = F.sum("c").over(Window.partitionBy("range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ordered = ranged.withColumn("inside", inside).join(before, "range").select(value, (F.col("before") + F.col("inside")).alias("upto"))
    at = lambda num, den: F.min(F.when(F.col("upto") > total * num // den, F.col(value)))
    return ordered.agg(*(at(*place).alias(name) for name, place in places.items()))


def group_quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, name...) linear quantiles of a double per group, nulls left out, exact, for groups of any size.

    Rows are sorted by (by, value) in ranges, which cut through groups as need be; a running count of a group's rows by
    range gives each row its rank, and the two neighbours of each quantile are picked. No group is held as a whole.
    """
    kept = rows.select(by, F.col(value).cast("double").alias("x")).filter("x is not null")
    counted = kept.groupBy(by, "x").agg(F.count("*").alias("c"))
    ranged = stage(counted.repartitionByRange(by, "x").withColumn("range", F.spark_partition_id()), "value-ranges")
    sizes = ranged.groupBy(by, "range").agg(F.sum("c").alias("n"))  # at most a row for each group and range
    of_group = Window.partitionBy(by)
    before = F.coalesce(F.sum("n").over(of_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(by).alias("_by"), F.col("range").alias("_range"), before.alias("before"), F.sum("n").over(of_group).alias("total"))
    inside = F.sum("c").over(Window.partitionBy(by, "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("inside", inside).join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("range") == F.col("_range")))
    placed = placed.withColumn("last", F.col("before") + F.col("inside") - 1).withColumn("first", F.col("last") - F.col("c") + 1)

    def at(share: float) -> Column:
        place = (F.col("total") - 1) * F.lit(share)
        low = F.floor(place)
        held = lambda k: F.max(F.when((F.col("first") <= k) & (k <= F.col("last")), F.col("x")))
        a, b = held(low), held(F.ceil(place))
        return a + (b - a) * F.max(place - low)

    return placed.groupBy(by).agg(*(at(share).alias(name) for name, share in shares.items()))
