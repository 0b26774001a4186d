"""Building a corpus: filters, routing and lookups (F and J families) over uid-keyed tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brepflow.functions import text as T
from brepflow.session import stage

MAX_ENTITIES = 500
#: A train split of fewer rows is refused.
LEAST_TRAIN_ROWS = 100
#: Order in which splits win where a uid is listed in several; fixed values.
PRIORITY = {"train": 1, "val": 2, "test": 3}


def splits(manifest: DataFrame, normalise: bool = True) -> DataFrame:
    """(uid, split), one row per uid, train before val before test (F05; F06 keeps uids as they are)."""
    parts = [manifest.select(F.explode(name).alias("uid"), F.lit(rank).alias("rank")) for name, rank in PRIORITY.items()]
    listed = reduce(DataFrame.unionByName, parts).filter("uid is not null")
    uid = T.normal_uid(F.col("uid")) if normalise else F.col("uid")
    ranked = listed.groupBy(uid.alias("uid")).agg(F.min("rank").alias("rank"))
    return ranked.select("uid", F.element_at(F.array(*map(F.lit, PRIORITY)), F.col("rank")).alias("split"))


def routed(records: DataFrame, manifest: DataFrame, normalise: bool = True) -> DataFrame:
    """each record with its split, or ``unmatched``. One shuffle on the uid, or none if the manifest is small."""
    key = T.normal_uid(F.col("uid")) if normalise else F.col("uid")
    of_uid = splits(manifest, normalise).withColumnRenamed("uid", "_key")
    return records.withColumn("_key", key).join(of_uid, "_key", "left").withColumn("split", F.coalesce("split", F.lit("unmatched"))).drop("_key")


def first_reason(*reasons: tuple[str, Column], otherwise: str = "kept") -> Column:
    """the first reason that holds."""
    out = F
    for name, holds in reasons:
        out = out.when(F.coalesce(holds, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def keep_small(records: DataFrame, text: Column, cap: int = MAX_ENTITIES) -> DataFrame:
    """fewer entities than the cap."""
    return records.filter(T.entity_count(text) < cap)


def within_tokens(records: DataFrame, text: Column, most: int, count: Callable[[Column], Column], most_characters: int | None = None) -> DataFrame:
    """texts of at most so many tokens by the tokenizer's ``count``; a cheap bound on characters goes first."""
    bound = records.filter(F.length(text) <= (most_characters if most_characters is not None else 4 * most))
    return bound.filter(count(text) <= most)


def usable_templates(index: DataFrame, cap: int = MAX_ENTITIES) -> DataFrame:
    """templates that are not empty and below the cap."""
    return index.filter((F.col("output") != "") & (T.entity_count(F.col("output")) < cap))


def retrieved_text(output: Column, cap: int = MAX_ENTITIES) -> Column:
    """The retrieved text, blank where it is missing or too large."""
    return F.coalesce(F.when(T.entity_count(output) < cap, output), F.lit(""))


def with_index(records: DataFrame, *order: str) -> DataFrame:
    """A gap-free ``idx`` from 0 in the given order.

    Ranges are sorted in parallel and written once; then one count per range is added up, so no
    task sees all rows.
    """
    ranged = records.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = ranged.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    local = stage(marked.withColumn("_i", F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33)).drop("_m"), "ranges")
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return local.join(before, "_p").withColumn("idx", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def guard_rows(records: DataFrame, least: int, what: str) -> DataFrame:
    """the records, or an error if there are fewer than ``least``."""
    found = records.limit(least).count()
    if found < least:
        raise ValueError(f"{what}: {found} rows, at least {least} are needed")
    return records


def guard_labels(records: DataFrame, required: list[str]) -> DataFrame:
    """the records, or an error if a required field is missing or blank somewhere."""
    bad = records.agg(*(F.count_if(T.is_blank(F.col(c))).alias(c) for c in required)).first()
    if missing := {c: bad[c] for c in required if bad[c]}:
        raise ValueError(f"blank fields: {missing}")
    return records


def shuffled(records: DataFrame, key: str = "uid", seed: int = 42) -> DataFrame:
    """a stable pseudo-random order."""
    return records.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def first_of_each(records: DataFrame, ok: Column, k: int, order: str) -> DataFrame:
    """the first k that hold and the first k that do not."""
    ranked = records.withColumn("ok", ok).withColumn("place", F.row_number().over(Window.partitionBy("ok").orderBy(order)))
    return ranked.filter(F.col("place") <= k)
