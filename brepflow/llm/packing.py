"""Filling containers of a fixed capacity: conflict-constrained best-fit decreasing.

Items are spread over packing groups of about ``GROUP_ITEMS`` by a hash of their id and place in the table, so a group
is a task of bounded size whatever source, set of copies or repeated row dominates; only ids and sizes are
shuffled. Within a group the items of clusters with more copies go first (at the end their copies would
each need a container of its own beside those that are full), then by falling size. Open containers are ordered by
their residual, kept as a bitmap of the residuals in use; the search takes the least residual
that holds the item and goes on, container by container and residual by residual, until the
tightest *compatible* one is found. A container carries a bitmap of the duplicate clusters
and one of the sources it holds:

* copies of one text (equal after folding case and white space) do not share a container. A
  cluster with more copies than its group needs containers at all cannot keep to that without
  waste; each container takes at most as many of its copies as spread them evenly over the
  containers that no item too large beside them fills;
* sources named together in ``apart`` do not share a container (none by default).

An item above the capacity fills containers of its own; what is left over is packed like any
item. The last containers of a group are the only ones left open.

Defined cases: null and empty texts, and texts without tokens, are left out; null ids, sources
and repeated rows are items like any other; ties are broken by id, piece and cluster.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brepflow.llm.bpe import NAME, PATTERN, TOKENIZERS
from brepflow.session import stage

GROUP_ITEMS = 20_000


@cache
def _counter(folder: str, name: str) -> tiktoken.Encoding:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, source, cluster, size) of each text with tokens; ``cluster`` hashes the folded text."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _counter(folder, name)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            size = [len(encoding.encode_ordinary(t)) for t in texts]
            cluster = np.array([xxhash.xxh3_64_intdigest(" ".join(t.lower().split())) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(cluster), pa.array(size, pa.int32())], ["doc_id", "source", "cluster", "size"])

    texts = documents.select("doc_id", "source", "text").filter("text is not null and text <> ''")
    return texts.mapInArrow(measured, "doc_id bigint, source string, cluster bigint, size int").filter("size > 0")


def _even(copies: int, size: int, ordered: np.ndarray, needed: int, capacity: int) -> int:
    """The least number of copies a container at which the containers with room for so many hold them all."""
    for n in range(1, capacity // size + 1):
        large = len(ordered) - int(np.searchsorted(ordered, capacity - n * size, "right"))
        if n * (needed - large) >= copies:
            return n
    return copies


def best_fit(sizes: np.ndarray, clusters: np.ndarray, sources: np.ndarray, capacity: int, apart: dict[int, int] | None = None) -> np.ndarray:
    """The container of each item (none above the capacity), in the given order of items.

    ``sources`` are small numbers; ``apart`` has, by source, the bitmap of sources it avoids.
    """
    apart = apart or {}
    needed = max(1, math.ceil(int(sizes.sum()) / capacity))
    _, of, copies = np.unique(clusters, return_inverse=True, return_counts=True)
    guarded = copies > 1
    most = np.ones(len(copies), np.int64)
    ordered = np.sort(sizes)
    for k in np.flatnonzero(copies > needed):
        most[k] = _even(int(copies[k]), int(sizes[of == k].max()), ordered, needed, capacity)
    bit_of = np.where(guarded, np.cumsum(guarded) - 1, -1)
    held: list[int] = []  # clusters of which the container takes no more
    so_far: dict[tuple[int, int], int] = {}
    from_sources: list[int] = []
    at_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    out = np.empty(len(sizes), np.int64)
    for i, (size, k, source) in enumerate(zip(sizes.tolist(), of.tolist(), sources.tolist())):
        bit = 1 << int(bit_of[k]) if bit_of[k] >= 0 else 0
        avoid = apart.get(source, 0)
        found, residual = -1, size
        while found < 0 and (rest := used >> residual):
            residual += (rest & -rest).bit_length() - 1
            row = at_residual[residual]
            for place in range(len(row) - 1, -1, -1):
                if not held[row[place]] & bit and not from_sources[row[place]] & avoid:
                    found = row.pop(place)
                    break
            if not row:
                used &= ~(1 << residual)
            if found < 0:
                residual += 1
        if found < 0:
            found, residual = len(held), capacity
            held.append(0)
            from_sources.append(0)
        if bit and most[k] > 1:
            so_far[found, k] = n = so_far.get((found, k), 0) + 1
            bit = bit if n >= most[k] else 0
        held[found] |= bit
        from_sources[found] |= 1 << source
        at_residual[residual - size].append(found)
        used |= 1 << (residual - size)
        out[i] = found
    return out


def _copies(clusters: np.ndarray) -> np.ndarray:
    """The number of copies of each item's cluster."""
    _, of, n = np.unique(clusters, return_inverse=True, return_counts=True)
    return n[of]


def _source_bits(names: list[str | None], apart: tuple[tuple[str, str], ...]) -> tuple[dict, dict[int, int]]:
    number = {x: i for i, x in enumerate(sorted(set(names), key=lambda x: (x is None, x or "")))}
    avoid: dict[int, int] = {}
    for a, b in apart:
        if a in number and b in number:
            avoid[number[a]] = avoid.get(number[a], 0) | 1 << number[b]
            avoid[number[b]] = avoid.get(number[b], 0) | 1 << number[a]
    return number, avoid


def pack(items: DataFrame, capacity: int, apart: tuple[tuple[str, str], ...] = (), group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_id, doc_id, piece_no, start, n_tokens): each item's place, or places above the capacity."""
    kept = stage(items.select("doc_id", "source", "cluster", "size"), "sized")
    groups = max(1, math.ceil(kept.count() / group_items))
    schema = "container_id bigint, doc_id bigint, piece_no int, start int, n_tokens int"

    def packed(table: pa.Table) -> pa.Table:
        d = table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        size = d["size"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-size // capacity))
        at = np.repeat(np.arange(len(d)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        n = np.minimum(size[at] - start, capacity)
        cluster = d["cluster"].to_numpy(np.int64)[at]
        number, avoid = _source_bits([None if x is None or x != x else x for x in d["source"]], apart)
        source = np.array([number[None if x is None or x != x else x] for x in d["source"]], np.int64)[at]
        ids = d["doc_id"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64)[at]
        order = np.lexsort((cluster, piece, ids, -n, -_copies(cluster)))
        place = best_fit(n[order], cluster[order], source[order], capacity, avoid)
        group = int(d["g"].iloc[0])
        return pa.table({
            "container_id": pa.array((group << 32) + place, pa.int64()),
            "doc_id": pa.Array.from_pandas(d["doc_id"].iloc[at[order]]).cast(pa.int64()),
            "piece_no": pa.array(piece[order] + 1, pa.int32()),
            "start": pa.array(start[order], pa.int32()),
            "n_tokens": pa.array(n[order], pa.int32()),
        })

    # the place in the written table tells rows apart that are equal in all columns, so none of them gather in one group
    salted = F.pmod(F.xxhash64("doc_id", "cluster", "size", F.monotonically_increasing_id()), F.lit(groups)).alias("g")
    return kept.select("*", salted).groupBy("g").applyInArrow(packed, schema)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, and the share of the capacity used."""
    of = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return of.agg(
        F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("n").alias("n_tokens"),
        F.round(F.sum("n") / (F.count("*") * F.lit(capacity)), 6).alias("fill"), F.max("n").alias("largest"),
    )


def rules_report(packed: DataFrame, documents: DataFrame, capacity: int, apart: tuple[tuple[str, str], ...]) -> DataFrame:
    """One row: documents placed, containers above the capacity, documents split below it, containers that hold sources to be kept apart."""
    by_document = packed.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"))
    documents_ = by_document.agg(F.count("*").alias("n_documents"), F.count_if((F.col("parts") > 1) & (F.col("n") <= capacity)).alias("n_split_needlessly"))
    sourced = packed.join(documents.select("doc_id", "source").distinct(), "doc_id", "left")
    together = F.lit(False)
    for a, b in apart:
        together |= F.coalesce(F.bool_or(F.col("source") == a), F.lit(False)) & F.coalesce(F.bool_or(F.col("source") == b), F.lit(False))
    by_container = sourced.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), together.alias("together"))
    containers = by_container.agg(F.count_if(F.col("n") > capacity).alias("n_above_capacity"), F.count_if("together").alias("n_apart_together"))
    names = ("n_documents", "n_split_needlessly", "n_above_capacity", "n_apart_together")
    return documents_.unionByName(containers, allowMissingColumns=True).agg(*(F.max(x).alias(x) for x in names))
