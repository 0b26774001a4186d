"""Splitting values above a size limit at statement ends, by byte ranges of files.

A value is a span of bytes of a file: a whole STEP file (``of_files``), or a table's value, written out by
the one scan of the table (``oversized``). No step after that holds a whole value:

1. *detect*: a worker opens a range of ``RANGE`` bytes with a halo of one byte. It does not know whether the
   range starts in code, a literal or a comment, so it reports its statement ends and its end
   state for every possible start state, with its number of characters;
2. *stitch*: the ranges' tables of a value stream by in order; end state becomes start state, and
   lengths are summed up, which gives the statement ends of the whole value;
3. *cut*: pieces are laid over the statement ends greedily as they stream by; what is kept are the
   ends within one piece and 40 bytes for each piece laid;
4. *emit*: a worker opens the range in which a piece starts and cuts the piece out by its offset.

Only ranges, offsets and, at last, pieces move; text is read from the file by the task that needs it.

A piece ends after the last statement end within ``max_size`` characters of its start; where
one statement alone is longer, it is cut at the limit. A piece after the first starts with as
many whole statements of its predecessor's end as fit into ``overlap`` characters; fewer, if
the next statement would else not fit, and none after a cut inside a statement.

Defined cases: null, empty and short enough values have no pieces; an unclosed literal or
comment runs to the value's end, and what follows the last statement end goes into the last
piece; rows repeated with the same id and value give one set of pieces, a null id being an id like
any other; further columns are not read. Sizes are code points; in a file that is not valid UTF-8
each byte that starts no character belongs to the one before, and shows as a replacement character.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brepflow.session import scratch, stage
from brepflow.sources import shared

#: Bytes of a range, and of the ranges that one task opens.
RANGE, TASK = 65536, 32 << 20
#: Neighbouring ranges of so many bytes go to the same task.
RUN = 1 << 20
#: States at a range's start; the last two start one character late, which a token of the range before took.
CODE, LITERAL, COMMENT, COMMENT_LATE, CODE_LATE = range(5)
#: The state whose statement ends stand for those of a late one where they are the same.
_PLAIN = {COMMENT_LATE: COMMENT, CODE_LATE: CODE}
_TOKEN = re.compile(r";|'[^']*'?|/\*.*?(?:\*/|\Z)", re.S)
_VALUE = ["row_id", "field", "max_size", "overlap", "path", "begin", "n_bytes"]
_SPANS = "row_id bigint, field string, h bigint, max_size int, overlap int, path string, begin bigint, n_bytes bigint"


def scan(text: str, n: int, state: int) -> tuple[list[int], int]:
    """Statement ends among the first n characters, and the state after them.

    ``text`` may go one character beyond n (the halo), so that a two-character token at the
    edge is seen by the range in which it starts.
    """
    ends: list[int] = []
    at = 0
    if state in (COMMENT_LATE, CODE_LATE):
        at, state = 1, COMMENT if state == COMMENT_LATE else CODE
    if state == LITERAL:
        close = text.find("'", at)
        if close < 0 or close >= n:
            return ends, LITERAL
        at, state = close + 1, CODE
    elif state == COMMENT:
        close = text.find("*/", at)
        if close < 0 or close >= n:
            return ends, COMMENT
        at, state = close + 2, CODE
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None or m.start() >= n:
            return ends, CODE
        token, at = m.group(), m.end()
        if token == ";":
            ends.append(at)
        elif token[0] == "'":
            if len(token) < 2 or token[-1] != "'" or at > n:
                return ends, LITERAL
        elif len(token) < 4 or not token.endswith("*/"):
            return ends, COMMENT_LATE if m.start() == n - 1 else COMMENT
        elif at == n + 1:
            return ends, CODE_LATE
    return ends, CODE_LATE if at > n else CODE


def starts(data: bytes, first: bool = False) -> np.ndarray:
    """Where characters start among the bytes; the first byte of a value always starts one."""
    at = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    if first and len(at):
        at[0] = True
    return at


def boundaries(data: bytes, n: int, first: bool) -> tuple[int, list[int], list[np.ndarray | None]]:
    """Of a range of n bytes with its halo: its characters, and by start state the state after it and its statement ends in characters.

    The first range of a value starts in code. Ends that equal those of the plain state are None.
    """
    upto = np.cumsum(starts(data[:n], first), dtype=np.int32)
    code = data.decode("latin-1")  # a character for each byte: the tokens are ASCII
    after, ends = [], []
    for state in (CODE,) if first else range(5):
        found, last = scan(code, n, state)
        chars = upto[np.array(found, np.int64) - 1] if found else np.empty(0, np.int32)
        plain = ends[_PLAIN[state]] if state in _PLAIN else None
        after.append(last)
        ends.append(None if plain is not None and np.array_equal(plain, chars) else chars)
    return int(upto[-1]), after, ends


class Pieces:
    """Pieces laid over statement ends that come in order: ``rows`` of (start, end, repeated characters)."""

    def __init__(self, max_size: int, overlap: int) -> None:
        if max_size < 1:
            raise ValueError("max_size must be positive")
        self.max_size, self.overlap = max_size, overlap
        self.rows: list[tuple[int, int, int]] = []
        self._ends: list[int] = []
        self._done, self._on_end, self._some = 0, False, False

    def feed(self, ends: list[int], known: int, last: bool) -> None:
        """The statement ends of the next characters, up to the ``known``-th; ``last`` if there are no more.

        A piece is laid once all that it depends on, up to ``max_size`` beyond the text done, is known.
        """
        self._ends += ends
        ends = self._ends
        while self._done < known and (last or known > self._done + self.max_size):
            done = start = self._done
            if self._on_end and self.overlap > 0:
                k = bisect_right(ends, done)
                need = ends[k] if k < len(ends) else known
                least = max(done - self.overlap, need - self.max_size)
                j = bisect_left(ends, least)
                if j < len(ends) and ends[j] < done:
                    start = ends[j]
                if least <= 0 and self._some and done <= self.overlap:
                    start = 0
            limit = start + self.max_size
            if last and limit >= known:
                end, on_end = known, False
            else:
                j = bisect_right(ends, limit) - 1
                on_end = j >= 0 and ends[j] > done
                end = ends[j] if on_end else limit
            if end <= done:  # the repeated statements leave no room
                start, end, on_end = done, min(done + self.max_size, known), False
            self.rows.append((start, end, done - start))
            self._done, self._on_end, self._some = end, on_end, True
        del ends[: bisect_left(ends, self._done - self.overlap)]

    def taken(self) -> list[tuple[int, int, int]]:
        """The rows laid since the last call."""
        rows, self.rows = self.rows, []
        return rows


def lay(ends: list[int], length: int, max_size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, repeated characters) of each piece of a value whose ends are all known."""
    pieces = Pieces(max_size, overlap)
    pieces.feed(list(ends), length, True)
    return pieces.rows


class _Reader:
    """Bytes of files; the last one stays open."""

    def __init__(self) -> None:
        self._path, self._file = None, None

    def __call__(self, path: str, begin: int, n: int) -> bytes:
        if path != self._path:
            self.close()
            fs, at = shared.opened(path)
            self._path, self._file = path, fs.open_input_file(at)
        return self._file.read_at(n, begin)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


def oversized(records: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Spans of the values that may be above their column's limit, written out by one scan of the table.

    ``limits`` has (max_size, overlap) by column. Values of no more bytes than ``max_size`` cannot be above it and
    stay where they are; all others are decided by their ranges. A task writes its values to one file.
    """
    spark = records.sparkSession
    folder = shared.qualified(spark, scratch(spark, "values"))
    names = list(limits)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared.opened(folder)
        name = uuid.uuid4().hex
        out, size = None, 0
        try:
            for batch in batches:
                at: list[int] = []
                rows: list[tuple] = []
                for field in names:
                    column = batch.column(field)
                    for i in range(batch.num_rows):
                        data = column[i].as_buffer()
                        if data is None or not len(data):
                            continue
                        if out is None:
                            fs.create_dir(base, recursive=True)
                            out = fs.open_output_stream(f"{base}/{name}")
                        out.write(data)
                        at.append(i)
                        rows.append((field, xxhash.xxh3_64_intdigest(data), *limits[field], f"{folder}/{name}", size, len(data)))
                        size += len(data)
                if rows:
                    field, h, max_size, overlap, path, begin, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row_id").take(pa.array(at)), pa.array(field), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(max_size, pa.int32()),
                            pa.array(overlap, pa.int32()), pa.array(path), pa.array(begin, pa.int64()), pa.array(n, pa.int64()),
                        ],
                        ["row_id", "field", "h", "max_size", "overlap", "path", "begin", "n_bytes"],
                    )
        finally:
            if out is not None:
                out.close()

    long = [F.when(F.octet_length(name) > most, F.col(name)).alias(name) for name, (most, _) in limits.items()]
    some = records.select(F.col("row_id").cast("bigint").alias("row_id"), *long).filter(F.coalesce(*names).isNotNull())
    spans = stage(some.mapInArrow(written, _SPANS), "spans")  # a task that runs again writes another file: spans must not be computed twice
    return spans.dropDuplicates(["row_id", "field", "h"])


def of_files(files: DataFrame, max_size: int, overlap: int) -> DataFrame:
    """Spans of whole files (path, length); the path is the field."""
    number = F.lit(None).cast("bigint")
    return files.filter("length > 0").select(
        number.alias("row_id"), F.col("path").alias("field"), number.alias("h"), F.lit(max_size).alias("max_size"), F.lit(overlap).alias("overlap"),
        "path", F.lit(0).cast("bigint").alias("begin"), F.col("length").alias("n_bytes"),
    )


def _near(rows: DataFrame, tasks: int, range_bytes: int) -> DataFrame:
    """The rows of (path, begin, part) over the tasks, neighbours together and in order."""
    run = F.floor((F.col("begin") + F.col("part").cast("bigint") * range_bytes) / RUN)
    return rows.repartition(tasks, "path", run).sortWithinPartitions("path", "begin", "part")


def _tasks(spans: DataFrame) -> int:
    total = spans.agg(F.sum("n_bytes")).first()[0] or 0
    return max(spans.sparkSession.sparkContext.defaultParallelism, ceil(total / TASK))


def _detected(spans: DataFrame, range_bytes: int) -> DataFrame:
    """Step 1: a row for each range."""
    columns = [*_VALUE, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = []
                for r in part.select(["path", "begin", "n_bytes", "part"]).to_pylist():
                    at = r["part"] * range_bytes
                    n = min(range_bytes, r["n_bytes"] - at)
                    data = read(r["path"], r["begin"] + at, min(n + 1, r["n_bytes"] - at))
                    found.append(boundaries(data, n, at == 0))
                ends = [e for f in found for e in f[2]]
                sizes = np.cumsum([0, *(0 if e is None else len(e) for e in ends)]).astype(np.int32)
                flat = pa.array(np.concatenate([e for e in ends if e is not None] or [np.empty(0, np.int32)]), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(sizes), flat, mask=pa.array([e is None for e in ends], pa.bool_()))
                states = pa.array(np.cumsum([0, *(len(f[1]) for f in found)]), pa.int32())
                after = pa.ListArray.from_arrays(states, pa.array([x for f in found for x in f[1]], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array([f[0] for f in found], pa.int32()), after, pa.ListArray.from_arrays(states, lists)], [*columns, "n_chars", "after", "ends"]
                )
        read.close()

    ranges = spans.select(*_VALUE, F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / range_bytes).cast("int"))).alias("part"))
    schema = "row_id bigint, field string, max_size int, overlap int, path string, begin bigint, n_bytes bigint, part int, n_chars int, after array<int>, ends array<array<int>>"
    return _near(ranges, _tasks(spans), range_bytes).mapInArrow(run, schema)


_CUTS = "row_id bigint, field string, path string, begin bigint, n_bytes bigint, piece_no bigint, n_pieces bigint, start bigint, n_chars bigint, n_repeated bigint, part int, at bigint"


def cut_table(spans: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Offsets of all pieces: (row_id, field, path, begin, n_bytes, piece_no, n_pieces, start, n_chars, n_repeated, part, at).

    Steps 2 and 3. ``start`` is the piece's first character in the value, ``at`` that in the range ``part`` where it starts.
    """
    names = [x.split()[0] for x in _CUTS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        value: dict = {}
        pieces = Pieces(1, 0)
        state, chars, placed = CODE, 0, []
        parts: list[int] = []  # first characters of the ranges
        for batch in batches:
            ends, after = batch.column("ends"), batch.column("after")
            inner = ends.values
            outer, at, flat = ends.offsets.to_numpy(), inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)
            missing = inner.is_null().to_numpy(zero_copy_only=False)
            for i, r in enumerate(batch.select([*_VALUE, "part", "n_chars"]).to_pylist()):
                if r["part"] == 0:
                    value, pieces = r, Pieces(r["max_size"], r["overlap"])
                    state, chars, placed, parts = CODE, 0, [], []
                k = outer[i] + state
                if missing[k]:
                    k = outer[i] + _PLAIN[state]
                parts.append(chars)
                last = (r["part"] + 1) * range_bytes >= r["n_bytes"]
                found = (flat[at[k] : at[k + 1]].astype(np.int64) + chars).tolist()
                state, chars = after[i].values[state].as_py(), chars + r["n_chars"]
                pieces.feed(found, chars, last)
                for start, end, repeated in pieces.taken():
                    first = bisect_right(parts, start) - 1
                    placed.append((start, end - start, repeated, first, start - parts[first]))
                if last and len(placed) > 1:
                    head = tuple(value[c] for c in ("row_id", "field", "path", "begin", "n_bytes"))
                    out += [(*head, n, len(placed), *p) for n, p in enumerate(placed, 1)]
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    found = _detected(spans, range_bytes).repartition("path", "begin").sortWithinPartitions("path", "begin", "part")
    return found.mapInArrow(run, _CUTS)


def pieces(spans: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """All pieces with their text: (row_id, field, piece_no, n_pieces, start, n_chars, n_repeated, text)."""
    names = ["row_id", "field", "piece_no", "n_pieces", "start", "n_chars", "n_repeated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader()
        held: tuple = ()
        data, at = b"", np.empty(0, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts: list[str] = []
                for r in part.select(["path", "begin", "n_bytes", "part", "at", "n_chars"]).to_pylist():
                    wanted = r["at"] + r["n_chars"]
                    begin = r["part"] * range_bytes
                    rest = r["n_bytes"] - begin
                    place = (r["path"], r["begin"], r["part"])
                    if held != place or (wanted >= len(at) and len(data) < rest):
                        data = read(r["path"], r["begin"] + begin, min(rest, range_bytes + 4 * r["n_chars"] + 4))
                        at, held = np.flatnonzero(starts(data, begin == 0)), place
                    stop = at[wanted] if wanted < len(at) else len(data)
                    texts.append(data[at[r["at"]] : stop].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])
        read.close()

    cuts = _near(cut_table(spans, range_bytes), _tasks(spans), range_bytes)
    return cuts.mapInArrow(run, "row_id bigint, field string, piece_no bigint, n_pieces bigint, start bigint, n_chars bigint, n_repeated bigint, text string")
