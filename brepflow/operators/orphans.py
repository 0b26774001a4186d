"""References to records that do not exist.

``orphan_keys`` is the operator: distinct non-null foreign keys, anti-joined against the
parent keys. Where parents are another table it is a distributed left anti-join. Where every
record brings its own parents (``within``), child and parent keys are co-located by construction, and the
anti-join is one of key sets in the row, hashed like any other, without an exchange. Both kinds of
references of a STEP corpus go through it:

* an instance reference ``#m`` of a statement, whose parents are the statements of the same
  text: the co-located form;
* a file reference of a DOCUMENT_FILE statement, whose parents are the files recorded as
  present at the row's time of ingestion: the distributed form. Parents are (uid, instant) keys found by a
  running sum over presence intervals in two levels (the minutes of a uid, of which a year has half a million,
  then the instants of a uid and minute), so no task ever orders all rows of a hot uid.

Orphan keys are joined back to the references that hold them, for rows and for counts per table and period.

Defined cases: null and empty texts hold no references; a null ``ingested_at`` is covered by
no interval, so every file reference of such a row is an orphan, of the null period; intervals
without a start, or that end before they start, cover nothing; a first argument that is not
a literal with a uid names no file; rows that repeat give one result row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brepflow.functions import steplex
from brepflow.session import stage

INSTANCE, FILE = "train_with_rag.step", "file_validation"
UID_SHAPE = r"^\w+[/_]\w+$"


def same_uid(uid: Column) -> Column:
    """Both spellings of a uid as the one with ``/``."""
    return F.replace(F.trim(uid), F.lit("_"), F.lit("/"))


def orphan_keys(children: DataFrame, parents: DataFrame | str, key: str | list[str]) -> DataFrame:
    """Distinct non-null foreign keys of ``children`` without a parent.

    With ``parents`` a table: rows of the ``key`` columns, by a left anti-join. With ``parents`` the name of an
    array column of ``children``, in which each record brings its own parent keys: ``children`` with the
    keys of its array column ``key`` that are not among them.
    """
    if isinstance(parents, str):
        return children.withColumn(key, F.array_compact(F.array_except(key, parents)))
    keys = [key] if isinstance(key, str) else key
    wanted = children.select(*keys).dropna(subset=keys).distinct()
    return wanted.join(parents.select(*keys), keys, "left_anti")


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = lambda lists: pa.array(lists, pa.list_(pa.int64()))
    for batch in batches:
        found = [steplex.references(t) if t else ([], [], []) for t in batch.column("step").to_pylist()]
        files = [steplex.file_references(t) if t else [] for t in batch.column("step").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row_id"), batch.column("ingested_at"), *(longs([f[k] for f in found]) for k in range(3)),
                longs([[n for n, _ in f] for f in files]), pa.array([[name for _, name in f] for f in files], pa.list_(pa.string())),
            ],
            ["row_id", "ingested_at", "sources", "targets", "defined", "file_sources", "names"],
        )


def references_to_resolve(train: DataFrame) -> DataFrame:
    """One scan of the texts: instance references that their own text leaves open, and all file references.

    (row_id, ingested_at, referred_table, src_eid, target); what is resolved within the text does not leave the scan.
    """
    fields = train.select("row_id", "ingested_at", "step").filter("step is not null and step <> ''")
    kind = dict(fields.dtypes)["ingested_at"]
    schema = f"row_id bigint, ingested_at {kind}, sources array<bigint>, targets array<bigint>, defined array<bigint>, file_sources array<bigint>, names array<string>"
    found = orphan_keys(fields.mapInArrow(_references, schema).withColumn("lost", F.col("targets")), "defined", "lost")
    holding = F.filter(F.arrays_zip("sources", "targets"), lambda r: F.array_contains("lost", r["targets"]))  # joined back
    inner = F.transform(holding, lambda r: F.struct(F.lit(INSTANCE).alias("referred_table"), r["sources"].alias("src_eid"), F.concat(F.lit("#"), r["targets"]).alias("target")))
    outer = F.transform(F.arrays_zip("file_sources", "names"), lambda r: F.struct(F.lit(FILE).alias("referred_table"), r["file_sources"].alias("src_eid"), same_uid(r["names"]).alias("target")))
    none = F.array().cast("array<struct<referred_table:string,src_eid:bigint,target:string>>")
    every = F.concat(F.when(F.size("lost") > 0, inner).otherwise(none), outer)
    rows = found.filter("size(lost) > 0 or size(names) > 0").select("row_id", "ingested_at", F.explode_outer(every).alias("r")).select("row_id", "ingested_at", "r.*").filter("target is not null")
    return rows.filter((F.col("referred_table") != FILE) | F.col("target").rlike(UID_SHAPE))


def present_keys(keys: DataFrame, intervals: DataFrame) -> DataFrame:
    """The (uid, at) rows of ``keys`` at which some [start, end) row of ``intervals`` holds that uid.

    Starts count +1 and ends -1; a key is present where the running sum is above zero. The sum is that of the minutes
    before and of the minute's instants so far.
    """
    held = intervals.filter("uid is not null and start is not null and (end is null or end > start)")  # repeated ones count alike at both ends
    change = lambda rows, at, d, asked: rows.select("uid", F.col(at).alias("at"), F.lit(d).alias("d"), F.lit(asked).alias("asked"))
    every = change(held, "start", 1, False).unionByName(change(held.filter("end is not null"), "end", -1, False)).unionByName(change(keys.dropna(subset=["uid", "at"]), "at", 0, True))
    points = every.groupBy("uid", "at").agg(F.sum("d").alias("d"), F.bool_or("asked").alias("asked"))
    points = points.withColumn("minute", F.date_trunc("minute", "at"))
    minutes = points.groupBy("uid", "minute").agg(F.sum("d").alias("of_minute"))
    before = Window.partitionBy("uid").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.select("uid", "minute", F.coalesce(F.sum("of_minute").over(before), F.lit(0)).alias("opening"))
    until = Window.partitionBy("uid", "minute").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = points.withColumn("so_far", F.sum("d").over(until)).filter("asked")
    return running.join(minutes, ["uid", "minute"]).filter("opening + so_far > 0").select("uid", "at")


def orphan_references(train: DataFrame, file_validation: DataFrame) -> DataFrame:
    """Every reference without its record: (row_id, ingested_at, referred_table, src_eid, target), distinct."""
    refs = stage(references_to_resolve(train).distinct(), "references")
    files = refs.filter(F.col("referred_table") == FILE).withColumns({"uid": F.col("target"), "at": F.col("ingested_at")})
    intervals = file_validation.select(same_uid(F.col("uid")).alias("uid"), F.col("recorded_at").alias("start"), F.col("removed_at").alias("end"))
    missing = orphan_keys(files, present_keys(files, intervals), ["uid", "at"])
    lost = files.join(missing, ["uid", "at"], "left_semi").unionByName(files.filter("at is null"))
    return refs.filter(F.col("referred_table") == INSTANCE).unionByName(lost.select(*refs.columns))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans and the rows that hold them, per referred table and month of ingestion."""
    return (
        orphans.groupBy("referred_table", F.date_format("ingested_at", "yyyy-MM").alias("month"), "row_id")
        .agg(F.count("*").alias("n"))
        .groupBy("referred_table", "month")
        .agg(F.sum("n").alias("n_orphans"), F.count("*").alias("n_rows"))
    )
