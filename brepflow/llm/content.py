"""Content of a record's fields as sets of 64-bit element hashes.

* ``step``: the distinct DATA statements that hold a decimal number (see ``ContentHasher``).
* ``caption``: the multiset of lower-case words without punctuation at their ends; the k-th
  occurrence of a word is its own element, so that set overlap is multiset overlap.

Defined cases: null and empty values, captions of fewer than ``MIN_WORDS`` words, and texts
without such statements have no content and no row here. Values with equal content share
``cid``, a hash of the whole content. Further columns of the input are not read.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from brepflow.functions.steplex import compact
from brepflow.llm.superminhash import mix64

MIN_WORDS = 8
SCHEMA = "field string, row_id bigint, cid bigint, n int, elems array<bigint>, b0 bigint, b1 bigint, b2 bigint, b3 bigint"
PARITY = ("b0", "b1", "b2", "b3")
_SEED = {"step": 1, "caption": 2}
_REF = re.compile(r"#\d+")
_NUMBER = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+)(?:E[+-]?\d+)?")
_DECIMAL = re.compile(r"\d\.|\.\d")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class ContentHasher:
    """Content of STEP texts as sets of 64-bit statement hashes.

    Content is the set of distinct DATA statements that hold a decimal number outside
    literals, without instance numbers and references, literal contents, comments, white
    space and case, decimals taken by value to six places.
    """

    def __init__(self) -> None:
        self._skeletons: dict[str, int] = {}

    def _skeleton(self, s: str) -> int:
        h = self._skeletons.get(s)
        if h is None:
            if len(self._skeletons) > 200_000:  # a memo only: clearing it changes no result
                self._skeletons.clear()
            h = self._skeletons[s] = xxhash.xxh3_64_intdigest(s)
        return h

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        rows: list[int] = []
        numbers: list[str] = []
        skeletons: list[int] = []
        counts: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = _REF.sub("", compact(text).upper()).split(";")[:-1]
            found = [p for p in parts if "." in p and _DECIMAL.search(p)]
            if not found:
                continue
            joined = ";".join(found)
            numbers += _NUMBER.findall(joined)
            parts = _NUMBER.sub("~", joined).split(";")
            skeletons += map(self._skeleton, parts)
            counts += [p.count("~") for p in parts]
            rows.append(i)
            rows += [i] * (len(parts) - 1)
        out = [np.empty(0, np.int64)] * len(texts)
        if not rows:
            return out
        n = np.array(counts, np.int64)
        with np.errstate(all="ignore"):
            value = np.array(numbers, "S").astype(np.float64) * 1e6
            near = np.rint(value)
            big = ~(np.abs(near) < 9e18)
            whole = np.where(big, 0, near).astype(np.int64).view(np.uint64)
            whole = np.where(big, value.view(np.uint64), whole)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            place = (np.arange(len(whole)) - np.repeat(starts, n)).astype(np.uint64)
            part = mix64(whole + (place + np.uint64(1)) * _STEP)
            total = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
            ends = np.cumsum(n)
            h = mix64(np.array(skeletons, np.uint64) ^ mix64(total[ends] - total[ends - n])).view(np.int64)
        rows_a = np.array(rows)
        edges = np.flatnonzero(np.diff(rows_a)) + 1
        for i, part_h in zip(rows_a[np.concatenate([[0], edges])], np.split(h, edges)):
            out[i] = np.unique(part_h)
        return out


def caption_words(text: str) -> list[str]:
    """Lower-case words, split at white space, without punctuation at their ends."""
    return [w for w in (x.strip(string.punctuation) for x in text.lower().split()) if w]


def caption_elements(text: str | None) -> np.ndarray:
    """The caption's (word, occurrence) hashes, sorted; empty for fewer than MIN_WORDS words."""
    words = caption_words(text) if text else []
    if len(words) < MIN_WORDS:
        return np.empty(0, np.int64)
    hashes = [xxhash.xxh3_64_intdigest(f"{w}\0{k}") for w, n in Counter(words).items() for k in range(n)]
    return np.sort(np.array(hashes, np.uint64).view(np.int64))


def parities(values: np.ndarray, sizes: list[int]) -> np.ndarray:
    """256 bits for each set, as four int64: bit i tells whether an odd number of its elements falls on i.

    Two sets differ in at least as many elements as their bits differ, whatever the hashes.
    """
    place = np.repeat(np.arange(len(sizes)), sizes) * 256 + ((values.view(np.uint64) >> np.uint64(29)) & np.uint64(255)).astype(np.int64)
    odd = (np.bincount(place, minlength=len(sizes) * 256) & 1).astype(np.uint8).reshape(len(sizes), 256)
    return np.packbits(odd, axis=1).view(np.int64)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = ContentHasher()
    for batch in batches:
        ids = batch.column("row_id").to_pylist()
        for start in range(0, len(ids), 256):
            part = slice(start, start + 256)
            rows: list[tuple[str, int, int, np.ndarray]] = []
            steps = hasher(batch.column("step").slice(start, 256).to_pylist())
            captions = map(caption_elements, batch.column("caption").slice(start, 256).to_pylist())
            for field, sets in (("step", steps), ("caption", captions)):
                for row_id, elems in zip(ids[part], sets):
                    if len(elems):
                        cid = xxhash.xxh3_64_intdigest(elems.tobytes(), seed=_SEED[field])
                        rows.append((field, row_id, cid, elems))
            if rows:
                sizes = [len(r[3]) for r in rows]
                values = np.concatenate([r[3] for r in rows])
                bits = parities(values, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.string()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array(np.array([r[2] for r in rows], np.uint64).view(np.int64)),
                        pa.array(sizes, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values)),
                        *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)),
                    ],
                    ["field", "row_id", "cid", "n", "elems", *PARITY],
                )


def contents(train: DataFrame) -> DataFrame:
    """(field, row_id, cid, n, elems, parity bits) for each value with content; one scan of the texts."""
    return train.select("row_id", "step", "caption").mapInArrow(_contents, SCHEMA)


def classes(contents_: DataFrame) -> DataFrame:
    """One row per distinct content: (field, cid, n, elems, parity bits)."""
    return contents_.drop("row_id").dropDuplicates(["cid"])
