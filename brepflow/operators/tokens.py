"""Token rows for training (K family), as array expressions over the ids that a tokenizer gives.

The tokenizer is the caller's: a Column function, or ``counter`` over a library. Byte tokens (each UTF-8 byte is its
own id) need neither a vocabulary nor Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MASK = -100


def byte_ids(text: Column) -> Column:
    """The ids of a text by the byte tokenizer; null for null."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def byte_count(text: Column) -> Column:
    """The number of byte tokens."""
    return F.octet_length(text)


def counter(make: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """A token count by a library: ``make`` gives the function from a text to its tokens' number, once for each worker's task."""

    @F.pandas_udf("int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make()
        for texts in batches:
            yield texts.map(count, na_action="ignore").astype("Int32")

    return counted


def truncated(ids: Column, most: int) -> Column:
    """K04"""
    return F.slice(ids, 1, most)


def cut_text(text: Column, most: int) -> Column:
    """The text's longest prefix of at most so many byte tokens that ends with a whole character."""
    cut = [F.substring(F.encode(text, "UTF-8"), 1, n).cast("string") for n in range(most, max(most - 4, -1), -1)]
    return F.coalesce(*(F.when(F.is_valid_utf8(c), c) for c in cut))


def after_header(ids: Column, header: list[int]) -> Column:
    """The index after the first occurrence of the header, or -1."""
    n = len(header)
    wanted = F.array(*map(F.lit, header))
    starts = F.when(F.size(ids) >= n, F.sequence(F.lit(1), F.size(ids) - (n - 1))).otherwise(F.array().cast("array<int>"))
    hit = F.filter(starts, lambda i: F.slice(ids, i, F.lit(n)) == wanted)
    return F.when(ids.isNotNull(), F.coalesce(F.get(hit, F.lit(0)) + (n - 1), F.lit(-1)))


def labels(ids: Column, header: list[int]) -> Column:
    """Ids with everything up to the header masked; all masked where there is none."""
    k = after_header(ids, header)
    hidden = lambda n: F.array_repeat(F.lit(MASK), n)
    return F.when(k < 0, hidden(F.size(ids))).otherwise(F.concat(hidden(k), F.slice(ids, k + 1, F.size(ids))))


def batched(ids: Column, batch: Column) -> Column:
    """Padded at the right to the longest row of the batch."""
    return padded(ids, F.max(F.size(ids)).over(Window.partitionBy(batch)))


def padded(ids: Column, width: Column, pad: int = 0) -> Column:
    """Padded at the right."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0))))


def generation_budget(prompt_tokens: Column, most: int) -> Column:
    """K06"""
    return F.greatest(F.lit(256), F.lit(most) - prompt_tokens - 64)


def unmasked_share(row: Column) -> Column:
    """A23"""
    return F.round(F.try_divide(F.size(F.filter(row, lambda x: x != MASK)), F.size(row)), 6)


def formatted(spark: SparkSession, folder: str, parameters: tuple[str, ...], make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The rows that ``make`` gives, kept in ``folder`` under the key of the parameters; and whether they were there.

    The writer's success mark is the ready flag: rows without it were left by a run that failed, and are made anew.
    """
    key = hashlib.sha256("|".join(parameters).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{key}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    ready = mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
    if not ready:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), ready
