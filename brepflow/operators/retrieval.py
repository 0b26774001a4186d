"""Exact top-1 retrieval by inner product, without the query itself.

An index of at most ``BROADCAST_BYTES`` by its measured size is sent to the workers once, and queries stream by it:
nothing is shuffled. A larger one is cut into blocks of about BLOCK_ROWS rows and the queries into slices of as many; each
pair of a block and a slice is one task-sized group and one matrix product in a worker that keeps the best candidate of each query, and a last
aggregation takes the best over the blocks. Ties go to the smaller id. A fixed query set
against all rows in blocks is no all-pairs join: only one row per query and block is kept.

Defined cases: vectors are as long as that of the index's least id; null ones and ones of another
length are neither queries nor candidates; a query without a candidate has no row (``fallback_self`` gives itself).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

BLOCK_ROWS = 4096
#: Size of an index that is sent to every worker.
BROADCAST_BYTES = 64 << 20


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def embedded(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], column: str = "text", batch: int = 256) -> DataFrame:
    """The texts with their vectors ``v`` by the given encoder; null texts have null vectors."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            given = frame.column(column).to_pylist()
            at = [i for i, t in enumerate(given) if t is not None]
            vectors: list[list[float] | None] = [None] * len(given)
            for first in range(0, len(at), batch):
                part = at[first : first + batch]
                for i, v in zip(part, np.asarray(encoder([given[i] for i in part]), np.float32).tolist()):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(vectors, pa.list_(pa.float32()))], [*frame.schema.names, "v"])

    return texts.mapInArrow(run, StructType([*texts.schema.fields, StructField("v", ArrayType(FloatType()))]))


_FOUND = pa.schema([("id", pa.int64()), ("best_id", pa.int64()), ("score", pa.float64())])


def _matrix(vectors: pa.Array, ids: np.ndarray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(ids), -1)


def _best(ids: np.ndarray, vectors: np.ndarray, others: np.ndarray, matrix: np.ndarray) -> pa.Table:
    """The best other of each query; ``others`` ascend, so the first of equal scores has the smaller id."""
    best, score = np.empty(len(ids), np.int64), np.full(len(ids), -np.inf)
    for first in range(0, len(ids), 1024):
        part = slice(first, first + 1024)
        scores = vectors[part] @ matrix.T
        scores[ids[part, None] == others[None, :]] = -np.inf
        at = scores.argmax(axis=1)
        best[part], score[part] = others[at], scores[np.arange(len(at)), at]
    keep = np.isfinite(score)
    return pa.table({"id": ids[keep], "best_id": best[keep], "score": score[keep]}, schema=_FOUND)


def top_one(queries: DataFrame, index: DataFrame, block_rows: int = BLOCK_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, best_id, score) over tables (id, v); the id itself is no candidate."""
    measured = index.filter("v is not null").agg(F.count("*").alias("n"), F.min_by(F.size("v"), "id").alias("width")).first()
    n, width = measured["n"], measured["width"] or 0
    whole = F.col("v").isNotNull() & (F.size("v") == width)
    asked, held = queries.filter(whole).select("id", "v"), index.filter(whole).select("id", "v")
    if n * (width + 1) * 8 <= broadcast_bytes:
        rows = held.toArrow()
        others = rows.column("id").to_numpy()
        order = np.argsort(others, kind="stable")
        matrix = _matrix(rows.column("v").combine_chunks(), others)[order] if n else np.empty((0, width))
        shared = queries.sparkSession.sparkContext.broadcast((others[order], matrix))

        def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            others, matrix = shared.value
            for batch in batches:
                if batch.num_rows and len(others):
                    ids = batch.column("id").to_numpy()
                    yield from _best(ids, _matrix(batch.column("v"), ids), others, matrix).to_batches()

        return asked.mapInArrow(streamed, "id bigint, best_id bigint, score double")
    blocks, slices = (max(1, -(-size // block_rows)) for size in (n, queries.count()))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    numbered = held.select(F.col("id").alias("other"), F.col("v").alias("w"), place(blocks).alias("b"), numbers(slices).alias("s"))
    asked = asked.select("id", "v", place(slices).alias("s"), numbers(blocks).alias("b"))

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_columns and right.num_columns and left.num_rows and right.num_rows):  # a side without the group
            return _FOUND.empty_table()
        ids, others = left.column("id").to_numpy(), right.column("other").to_numpy()
        order = np.argsort(others, kind="stable")
        matrix = _matrix(right.column("w").combine_chunks(), others)[order]
        return _best(ids, _matrix(left.column("v").combine_chunks(), ids), others[order], matrix)

    found = asked.groupBy("b", "s").cogroup(numbered.groupBy("b", "s")).applyInArrow(matched, "id bigint, best_id bigint, score double")
    top = found.groupBy("id").agg(F.max(F.struct("score", (-F.col("best_id")).alias("n"))).alias("t"))
    return top.select("id", (-F.col("t.n")).alias("best_id"), F.col("t.score").alias("score"))


def fallback_self(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Each query with its best other, or itself where there is none."""
    return queries.select("id").join(found, "id", "left").select("id", F.coalesce("best_id", "id").alias("best_id"))
