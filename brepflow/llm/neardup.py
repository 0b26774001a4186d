"""Near-duplicate records: SuperMinHash signatures, banding, verification, union-find.

Rows of equal content are one class; only classes are signed, banded and compared, and
pairs of classes are expanded to pairs of rows last. Candidates are classes that agree in a
whole band and whose sizes alone allow the similarity; every candidate is verified on the
whole contents: common elements / elements of the larger >= ``THRESHOLD``. The bands are a
self-join on the band key. A key of more than ``HOT`` classes is split: its classes are dealt out to
parts of about ``HOT``, and every part meets all of the key's classes in a task of its own. So no
bucket is collected, capped or dropped, whatever share of the classes it holds.

A pair at the threshold has a Jaccard similarity of at least 2/3 (equal sizes); the bands of
``BANDS`` find such a pair with a probability of 0.994 (caption) or 0.999 (step), and one of a
similarity of 0.85 with 0.99999 or more.

Defined cases: values without content (null, empty, too short) are in no pair and in no
group; equal values are pairs; a row is never paired with itself; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brepflow.llm.content import PARITY, classes
from brepflow.llm.superminhash import band_keys, signatures
from brepflow.session import stage

THRESHOLD = 0.8
#: Classes of a band key that one task joins with the key's classes.
HOT = 2_000
#: Rows of a class that one task meets with the rows of another, or of the same.
HOT_ROWS = 2_000
#: Edges that union-find unites at a time; the stars of one portion and the next are joined across partitions anyway.
PORTION = 500_000
#: Bands and rows of a band, by field.
BANDS = {"step": (75, 6), "caption": (128, 8)}


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            field = np.array(part.column("field").to_pylist())
            cid = part.column("cid").to_numpy(zero_copy_only=False)
            n = part.column("n").to_numpy(zero_copy_only=False)
            elems = part.column("elems")
            values, offsets = elems.values.to_numpy(zero_copy_only=False), elems.offsets.to_numpy()
            for seed, (name, (bands, rows)) in enumerate(BANDS.items()):
                own = np.flatnonzero(field == name)
                if len(own):
                    sets = [values[offsets[i] : offsets[i + 1]] for i in own]
                    keys = band_keys(signatures(sets, bands * rows), bands, rows, seed)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(cid[own], bands)), pa.array(np.repeat(n[own], bands).astype(np.int32))],
                        ["key", "cid", "n"],
                    )


def candidates(distinct: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of classes that share a band and whose sizes allow the similarity."""
    bands = stage(distinct.select("field", "cid", "n", "elems").mapInArrow(_banded, "key bigint, cid bigint, n int"), "bands")
    counts = bands.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    several = counts.select("key", F.ceil(F.col("held") / HOT).cast("int").alias("parts"))
    shared = stage(bands.join(several, "key"), "shared-bands", instead_of=bands)  # most keys are held by one class only
    fits = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9
    cold, hot = shared.filter("parts = 1"), shared.filter("parts > 1")
    dealt = hot.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    met = hot.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = None
    for left, right, by in ((cold, cold, ["key"]), (dealt, met, ["key", "part"])):
        pairs = left.select(*by, F.col("cid").alias("a"), F.col("n").alias("n_a")).join(right.select(*by, F.col("cid").alias("b"), F.col("n").alias("n_b")), by)
        pairs = pairs.filter((F.col("a") < F.col("b")) & fits).select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def _side(distinct: DataFrame, name: str, *columns: str) -> DataFrame:
    return distinct.select(F.col("cid").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))


def possible(pairs: DataFrame, distinct: DataFrame, of: Column, threshold: float) -> DataFrame:
    """The pairs that the parity bits leave possible.

    Sets whose bits differ in h places share at most (n_a + n_b - h) / 2 elements. The bound costs 40 bytes
    a class and drops nearly all candidates that are far apart, and none that is not.
    """
    sketched = pairs.join(_side(distinct, "a", "n", *PARITY), "a").join(_side(distinct, "b", "n", *PARITY), "b")
    differ = sum(F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in PARITY)
    return sketched.filter((F.col("n_a") + F.col("n_b") - differ) / 2 >= F.lit(threshold) * of - 1e-9).select("a", "b")


def verified(pairs: DataFrame, distinct: DataFrame, of: Column, threshold: float) -> DataFrame:
    """The pairs whose common elements are at least ``threshold`` of ``of`` (over n_a and n_b), on whole contents."""
    common = F.size(F.array_intersect("elems_a", "elems_b"))
    both = pairs.join(_side(distinct, "a", "field", "n", "elems"), "a").join(_side(distinct, "b", "n", "elems"), "b")
    return both.filter(common >= F.lit(threshold) * of - 1e-9).select(F.col("field_a").alias("field"), "a", "b")


def similar_classes(contents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (field, a, b) of different contents whose similarity reaches the threshold."""
    distinct = stage(classes(contents), "classes")
    larger = F.greatest("n_a", "n_b")
    return verified(possible(candidates(distinct, threshold), distinct, larger, threshold), distinct, larger, threshold)


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Class pairs (a, b) as pairs of rows: each row of ``left`` (a, x) with each of ``right`` (b, y).

    The rows of a class are dealt out to parts of about ``HOT_ROWS``, and each two parts meet by themselves, so a class
    that holds a third of all rows is spread over as many tasks as its pairs are worth.
    """
    out, sides = pairs, []
    for rows, key, of in ((left, "a", "x"), (right, "b", "y")):
        parts = rows.groupBy(key).agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("parts"))
        dealt = rows.join(parts, key).withColumn(f"part_{key}", F.pmod(F.xxhash64(of), F.col("parts")).cast("int")).drop("parts")
        out = out.join(parts, key).withColumn(f"part_{key}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        sides.append((dealt, [key, f"part_{key}"]))
    for dealt, by in sides:
        out = out.join(dealt, by)
    return out.drop("part_a", "part_b")


def row_pairs(contents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(field, row_id_a, row_id_b) of the class pairs and of the rows of one class."""
    rows = contents.select("cid", "row_id").distinct()
    several = contents.groupBy("field", "cid").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).filter("lo < hi")
    both = pairs.select("field", "a", "b").unionByName(several.selectExpr("field", "cid as a", "cid as b"))
    out = expanded(both, rows.selectExpr("cid as a", "row_id as x"), rows.selectExpr("cid as b", "row_id as y"))
    return out.filter("a <> b or x < y").filter("x <> y").select(
        "field", F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")
    ).distinct()


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges, a portion at a time, as the edges from each node to the least node of its component there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in parent if find(x) != x]
        for i in range(0, len(nodes), 65536):
            part = nodes[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])
        parent.clear()

    united = 0
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        united += batch.num_rows
        if united >= PORTION:
            yield from stars()
            united = 0
    yield from stars()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node of an edge, and the least node of its component (the least itself included).

    Each partition unites its own edges with union-find; what is left are stars, joined across
    partitions by alternating large and small stars until a round changes nothing. Rounds are
    written to the shared folder, and only a count and a checksum come to the driver.
    """
    now = edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").mapInArrow(_union_find, "u bigint, v bigint").distinct()
    now, seen = stage(now, "stars"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.unionByName(now.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(least, "u").filter("v > u").selectExpr("v as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").selectExpr("v as u", "m as v").unionByName(least.selectExpr("u", "m as v"))
        now = stage(small.distinct(), "stars", instead_of=now)
    return now.unionByName(now.selectExpr("v as u", "v").distinct())


def near_duplicate_pairs(contents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of rows with nearly the same content: (field, row_id_a, row_id_b)."""
    kept = stage(contents, "contents")
    return row_pairs(kept, similar_classes(kept, threshold))


def near_duplicate_groups(contents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per value with content: (field, row_id, class_id, group_id, n_links).

    ``class_id`` is the least row_id of equal content, ``group_id`` the least row_id of the
    group that the links form, ``n_links`` the number of rows the value is nearly equal to.
    """
    kept = stage(contents, "contents")
    pairs = stage(similar_classes(kept, threshold), "class-pairs")
    of_class = kept.groupBy("field", "cid").agg(F.min("row_id").alias("class_id"), F.count("*").alias("members"))
    sizes = of_class.select("cid", "members")
    directed = pairs.selectExpr("a as cid", "b as other").unionByName(pairs.selectExpr("b as cid", "a as other"))
    links = directed.join(sizes.withColumnRenamed("cid", "other"), "other").groupBy("cid").agg(F.sum("members").alias("near"))
    group = components(pairs).selectExpr("u as cid", "v as root")
    grouped = of_class.join(links, "cid", "left").join(group, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    heads = grouped.groupBy("root").agg(F.min("class_id").alias("group_id"))
    described = grouped.join(heads, "root").selectExpr("cid", "class_id", "group_id", "members - 1 + coalesce(near, 0) as n_links")
    return kept.select("field", "row_id", "cid").join(described, "cid").select("field", "row_id", "class_id", "group_id", "n_links")
