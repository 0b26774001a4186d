"""Encoding of a corpus with a public byte-level BPE, by DuckDB recursive queries per partition.

Each worker splits its texts into words with the tokenizer's own pattern and keeps what it
does not know yet. Those words become token-position rows, one per byte. A recursive query
joins neighbouring rows with the merge table, takes each word's pair of minimum rank, and
contracts it from the left on at all places that do not overlap: of a run of overlapping
places (a pair of equal halves) every other one, from the leftmost on. That is what contracting the
leftmost place again and again gives, since no contraction can make a pair of lower rank. A
word leaves the recursion when no pair of its is in the merge table. An ordered aggregation
reads the ids of each word off its last rows.

A recursion goes ``DEPTH`` steps at most, and fewer for long words; words that are not done start
again from their last rows. So the rows kept are bounded by ROWS, or the bytes of one word if that is longer.

Defined cases: null and empty texts give an empty array; blank texts are encoded; strings that
look like special tokens are ordinary text; rows that repeat are encoded each.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: The splitting pattern of the tokenizer; fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII characters, in classes that the standard library's faster matcher has.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
DEPTH = 48
#: Rows that one recursion may keep; longer words take fewer steps at a time.
ROWS = 3_000_000
#: Bytes of words that go through one recursion together; a longer word goes alone.
CHUNK_BYTES = 60_000
#: Words that a worker remembers; forgetting costs time only.
MEMO = 300_000

_MERGE = """
with recursive step(i, word, pos, tok) as (
  select 0, word, pos, tok from bytes
  union all
  select * from (
    with pair as (
      select i, word, pos, tok, lead(tok) over w as right_tok, lead(pos) over w as right_pos, row_number() over w as place
      from step window w as (partition by word order by pos)
    ), ranked as (
      select p.*, m.rank, m.merged from pair p left join merges m on m.l = p.tok and m.r = p.right_tok
    ), least as (
      select word, min(rank) as rank from ranked where rank is not null group by word
    ), found as (
      select r.word, r.pos, r.right_pos, r.merged, r.place - row_number() over (partition by r.word order by r.pos) as run
      from ranked r join least b on b.word = r.word and b.rank = r.rank
    ), taken as (
      select word, pos, right_pos, merged from found qualify row_number() over (partition by word, run order by pos) % 2 = 1
    )
    select p.i + 1, p.word, p.pos, coalesce(t.merged, p.tok) from pair p join least b on b.word = p.word
    left join taken t on t.word = p.word and t.pos = p.pos
    where p.i < {depth} and not exists (select 1 from taken x where x.word = p.word and x.right_pos = p.pos)
  )
), last as (select word, max(i) as i from step group by word)
select s.word, any_value(s.i) as i, list(s.tok order by s.pos) as ids from step s join last using (word, i) group by s.word
"""


class Encoder:
    """Word-wise encoding with one tokenizer; one per worker process."""

    def __init__(self, folder: str, name: str) -> None:
        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        columns = {
            "l": [vocab[a] for a, _ in merges],
            "r": [vocab[b] for _, b in merges],
            "rank": range(len(merges)),
            "merged": [vocab[a + b] for a, b in merges],
        }
        self._of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._pattern, self._ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.A)
        self._forget()
        # no temp_directory: what one recursion keeps is bounded, so it must not spill to a machine's own disk
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        given = pa.table({k: pa.array(v, pa.int32()) for k, v in columns.items()})  # noqa: F841
        self._db.execute("create table merges as select * from given")

    def _forget(self) -> None:
        """An empty memo: each known word's number, and the ids of word k at ``_ids[_at[k]:_at[k + 1]]``."""
        self._memo: dict[str, int] = {}
        self._ids, self._at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _contract(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Token ids of each word, given as its rows' tokens."""
        done: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        left = list(range(len(words)))
        while left:
            lengths = [len(words[k]) for k in left]
            bytes_ = pa.table({  # noqa: F841
                "word": np.repeat(np.array(left, np.int32), lengths),
                "pos": np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]),
                "tok": np.concatenate([words[k] for k in left]),
            })
            depth = max(1, min(DEPTH, ROWS // sum(lengths)))
            self._db.register("bytes", bytes_)
            rows = self._db.sql(_MERGE.format(depth=depth)).to_arrow_table().combine_chunks()
            self._db.unregister("bytes")
            ids = rows.column("ids").combine_chunks()
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            left = []
            for j, (k, i) in enumerate(zip(rows.column("word").to_pylist(), rows.column("i").to_pylist())):
                found = flat[at[j] : at[j + 1]].astype(np.int32)
                if i < depth:
                    done[k] = found
                else:
                    words[k] = found
                    left.append(k)
        return done

    def _learn(self, words: list[str]) -> None:
        raw = sorted((w.encode() for w in words), key=len)
        found: list[np.ndarray] = []
        first = 0
        while first < len(raw):
            stop, size = first, 0
            while stop < len(raw) and (stop == first or size + len(raw[stop]) <= CHUNK_BYTES):
                size += len(raw[stop])
                stop += 1
            found += self._contract([self._of_byte[np.frombuffer(w, np.uint8)] for w in raw[first:stop]])
            first = stop
        known = len(self._memo)
        self._memo.update((w.decode(), known + k) for k, w in enumerate(raw))
        self._ids = np.concatenate([self._ids, *found])
        self._at = np.concatenate([self._at, self._at[-1] + np.cumsum([len(x) for x in found])])

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text."""
        return self.encoded(texts).to_pylist()

    def encoded(self, texts: list[str | None]) -> pa.ListArray:
        """Token ids of each text, as an Arrow array."""
        split = [(self._ascii if t.isascii() else self._pattern).findall(t) if t else [] for t in texts]
        if len(self._memo) > MEMO:
            self._forget()
        if new := {w for words in split for w in words if w not in self._memo}:
            self._learn(sorted(new))
        numbers = np.fromiter(map(self._memo.__getitem__, chain.from_iterable(split)), np.int64)
        begin, size = self._at[numbers], self._at[numbers + 1] - self._at[numbers]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self._ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        words = np.cumsum([0, *map(len, split)])
        return pa.ListArray.from_arrays(pa.array(upto[words].astype(np.int32)), pa.array(ids, pa.int32()))


@cache
def encoder(folder: str, name: str) -> Encoder:
    """The process's encoder."""
    return Encoder(folder, name)


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, ids): the ids of each row's text; nothing is shuffled."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), encode.encoded(part.column("text").to_pylist())], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encoded, "doc_id bigint, ids array<int>")
