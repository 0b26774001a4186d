"""Texts cut off by field limits or in transfer: a backward character n-gram model.

Read backward from a place in a text, the last k characters are its context. The corpus says,
for each context, how often a unit (sentence, line, STEP statement, text) *ends* after it and
how often the text *continues*. With ``n`` places and ``e`` ends, contexts of growing length are
blended: ``p = (e + PULL p') / (n + PULL)``, p' being the estimate of the next shorter context, so a long
context counts for as much as was seen of it. Counts are per language: of each context those of the other
languages are blended in first, then those of the value's own language, so a rare language (or a wrong
label) backs off to all. A value's final context gives the log-odds that a
unit ends there. Two kinds of evidence are added: the odds of an end after so many words of a
unit that starts with this word (headings, signatures and list items end in names of many
kinds), and a mark that stands in place of the rest. Values whose log-odds lie below the
threshold of their language were cut off.

A place before a final stop counts as an end, so a text that merely lacks its stop does not
look cut. A text's own end, and those of its copies, are taken out of the counts it is judged by.

Counts cover every place of every text. Only contexts that end some text matter, so their hashes
are first gathered in a bitmap of about ``BITS_A_KEY`` bits for each of them, of ``BITMAP_MOST`` bits (32 MB)
at most; counting passes over contexts that are not in it. What the bitmap lets through in
excess is dropped by the join on the whole hash, so the result does not depend on its size. Where
more than some 50 million different contexts end texts it fills up, and then more contexts are shuffled.

Defined cases: null, empty and blank texts are no cases; upper-case languages count as the
language, null ones as ``und``; copies labelled with the same language get equal results; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brepflow.llm.superminhash import mix64
from brepflow.session import stage

#: Context lengths in characters, digits of a number counting as one.
ORDERS = (2, 3, 4, 6, 9, 13, 18, 26)
PULL = 2.0
#: Log-odds that a mark in place of the rest takes off.
MARKED = 4.0
#: Bounds of the evidence from a unit's first word and length.
HEAD_BOUNDS = (-1.5, 6.0)
BITS_A_KEY, BITMAP_LEAST, BITMAP_MOST = 128, 1 << 16, 1 << 28
#: Counts that a worker holds before it hands them on.
HELD = 1_000_000
#: Characters whose places are worked on together.
PORTION = 300_000
#: So many texts, distributed as those of all languages are, are added to each language's own.
PRIOR_TEXTS = 500
#: Range in which a threshold is searched, and its step.
GAP_RANGE, GAP_STEP = (-2.5, 0.5), 0.25

_ZEROS = bytes.maketrans(b"123456789", b"000000000")
_LONG_NUMBER = re.compile(b"0{4,}")
#: Final stops, and those that no blank follows; fixed values.
STOPS, FULL_STOPS = ".!?。！？", "。！？"
_PAD = max(ORDERS) + 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _numbers(text: str) -> str:
    """Numbers of one to three digits as 0, longer ones as 00."""
    zeros = text.encode("utf-8", "surrogatepass").translate(_ZEROS)
    if b"0000" in zeros:
        zeros = _LONG_NUMBER.sub(b"\0\0", zeros)
    return zeros.replace(b"000", b"0").replace(b"00", b"0").replace(b"\0", b"0").decode("utf-8", "surrogatepass")


def _before_mark(text: str) -> str | None:
    """The text before a mark at its end, whatever blanks follow the mark or are in it; None where there is none."""
    kept = text.rstrip()
    opener = {"]": "[", ")": "("}.get(kept[-1:])
    inner = kept[:-1].rstrip() if opener else kept
    if inner.endswith("…"):
        rest = inner[:-1]
    elif inner.endswith("..."):
        rest = inner[:-3] if opener else inner.rstrip(".")
    else:
        return None
    if opener:
        rest = rest.rstrip()
        if not rest.endswith(opener):
            return None
        rest = rest[:-1]
    return rest.rstrip()


def folded(text: str) -> tuple[str, bool]:
    """The text as contexts see it (short numbers as 0, long ones as 00, blanks and line ends as one each), and whether a mark ended it."""
    before = _before_mark(text)
    body = text if before is None else before
    lines = [" ".join(line.split()) for line in _numbers(body).split("\n")]
    return "\n".join(filter(None, lines)), before is not None


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b)]), dtype=np.uint64) for b in (_BASE, _BASE_INVERSE))


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the first 65536 code points are in one of the ranges."""
    out = np.zeros(65536, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


_STOP = _table(*((ord(c), ord(c)) for c in STOPS))
_FULL = _table(*((ord(c), ord(c)) for c in FULL_STOPS))
_SMALL = _table((97, 122), (0xDF, 0xFF))
_WORD = _table((48, 57), (65, 90), (97, 122), (0xC0, 65535))
_EVEN = ~np.uint64(1)


class Places:
    """All places of a batch of folded texts: context hashes and whether a unit ends there.

    Hashes are even: their last bit is free for the outcome of a place.
    """

    def __init__(self, texts: list[str]) -> None:
        joined = ("\1" * _PAD).join(["", *texts, ""])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.code = code
        self._low = np.minimum(code, 65535).astype(np.uint16)
        size = 1 << max(16, int(len(code) + 1).bit_length())
        self._power, inverse = _powers(size)
        with np.errstate(over="ignore"):
            self._sums = np.concatenate([[np.uint64(0)], np.cumsum((code.astype(np.uint64) + np.uint64(7)) * inverse[: len(code)], dtype=np.uint64)])
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = _PAD + np.cumsum(np.concatenate([[0], lengths[:-1] + _PAD])) if len(texts) else lengths
        self.stops = self.starts + lengths
        #: Places are positions after a character of a text.
        self.at = np.flatnonzero(code != 1) + 1
        self.ends = self._ends()

    def _ends(self) -> np.ndarray:
        """By position i: a unit ends between code[i - 1] and code[i]."""
        code, low = self.code, self._low
        one = np.array([1], np.uint32)
        before, here = np.concatenate([one, code]), np.concatenate([code, one])
        before_low, after_low = np.concatenate([[np.uint16(1)], low]), np.concatenate([low[1:], [np.uint16(1), np.uint16(1)]])
        blank = here == 32
        end = (here == 1) | (here == 10) | (_STOP[before_low] & blank & ~_SMALL[after_low]) | _FULL[before_low]
        end |= (before == ord(";")) & blank & ((after_low == ord("#")) | (after_low == ord("E")))
        end[:-1] |= _STOP[low] & end[1:]
        return end

    def hashes(self, at: np.ndarray, begin: np.ndarray, salt: int) -> np.ndarray:
        """Hash of the characters from ``begin`` to ``at``."""
        with np.errstate(over="ignore"):
            value = (self._sums[at] - self._sums[begin]) * self._power[np.maximum(at, 1) - 1]
            value += np.uint64(salt + 1) * _BASE
        return mix64(value) & _EVEN

    def heads(self, at: np.ndarray) -> np.ndarray:
        """Hash of each place's unit: its first word and its number of words so far."""
        code = self.code
        n = len(code)
        index = np.arange(n + 1)
        before = np.concatenate([np.array([1], np.uint32), code])
        blank = np.concatenate([(code == 32) | (code == 10) | (code == 1), [True]])
        opens = (before == 1) | (before == 10) | ((before == 32) & np.concatenate([[False], self.ends[:-1]])) | _FULL[np.concatenate([[np.uint16(1)], self._low])]
        start = np.maximum.accumulate(np.where(opens, index, 0))
        next_blank = np.minimum.accumulate(np.where(blank, index, n)[::-1])[::-1]
        words = np.cumsum(blank)
        first = np.minimum(next_blank[start[at]], at)
        count = (words[np.maximum(at, 1) - 1] - words[np.maximum(start[at], 1) - 1]).astype(np.uint64)
        with np.errstate(over="ignore"):
            return mix64(self.hashes(first, start[at], 99) ^ mix64(count + np.uint64(1))) & _EVEN

    def holds(self, at: np.ndarray) -> np.ndarray:
        """By position: whether it is one of the places."""
        out = np.zeros(len(self.code) + 1, bool)
        out[at] = True
        return out

    def word_ends(self, at: np.ndarray) -> np.ndarray:
        """Which of the places follow a letter or digit and precede none."""
        word = np.concatenate([_WORD[self._low], [False]])
        return word[at - 1] & ~word[at]


def _last_lines(text: str) -> str:
    """The end of a text from a line end on, long enough for all contexts; all of it where there is none.

    Units start after line ends, so the last unit and the last characters are whole.
    """
    at = text.rfind("\n", 0, max(0, len(text) - _PAD))
    return text[at:] if at >= 0 else text


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of the texts with at most PORTION characters each, but at least one text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "") + _PAD
        if i > first and size + n > PORTION:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def _finals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(ORDERS) + 1
    for batch in batches:
        for first, stop in _portions(batch.column("text").to_pylist()):
            part = batch.slice(first, stop - first)
            both = [folded(t) for t in part.column("text").to_pylist()]
            rows = [i for i, (t, _) in enumerate(both) if t]
            if not rows:
                continue
            places = Places([_last_lines(both[i][0]) for i in rows])
            keys = np.stack([*(places.hashes(places.stops, places.stops - k, k) for k in ORDERS), places.heads(places.stops)], axis=1).view(np.int64)
            at = pa.array(rows, pa.int64())
            text_hash = np.array([xxhash.xxh3_64_intdigest(both[i][0]) for i in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(at), part.column("lang").take(at), part.column("source").take(at),
                    pa.array([both[i][1] for i in rows], pa.bool_()), pa.array(text_hash),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(keys.ravel())),
                ],
                ["doc_id", "lang", "source", "marked", "text_hash", "keys"],
            )


def language(lang: Column) -> Column:
    """A language without case and blanks; ``und`` for null."""
    return F.coalesce(F.lower(F.trim(lang)), F.lit("und"))


def final_contexts(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, marked, text_hash, keys) of each text that is not blank."""
    texts = documents.select("doc_id", "lang", "source", "text").filter("text is not null and text <> ''")
    found = texts.mapInArrow(_finals, "doc_id bigint, lang string, source string, marked boolean, text_hash bigint, keys array<bigint>")
    return found.withColumn("lang", language(F.col("lang")))


def _bitmap(finals: DataFrame) -> np.ndarray:
    """The bitmap of all final contexts, as words of 64 bits; at most BITMAP_MOST / 64 rows come to the driver."""
    keys = finals.select(F.explode("keys").alias("k"))
    distinct = keys.agg(F.approx_count_distinct("k")).first()[0]
    bits = min(BITMAP_MOST, max(BITMAP_LEAST, 1 << (distinct * BITS_A_KEY).bit_length()))
    words = keys.groupBy(F.shiftrightunsigned("k", 64 - (bits // 64 - 1).bit_length()).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("bits"))
    rows = words.toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[rows.column("i").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bitmap


def _counts(keys: np.ndarray, n: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys once each, in order, with their summed counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first), np.add.reduceat(e[order], first)


def context_counts(documents: DataFrame, finals: DataFrame) -> DataFrame:
    """(key, n, e, by_lang): places and ends over the whole corpus, of every context that ends some text, and those in each language."""
    shared = documents.sparkSession.sparkContext.broadcast(_bitmap(finals))

    def outcomes(texts: list[str], known) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        both = [folded(t) for t in texts]
        places = Places([t for t, _ in both if t])
        marked = np.array([m for t, m in both if t], bool)
        is_stop = places.holds(places.stops)
        at = places.at[~places.holds(places.stops[marked])[places.at]]  # a marked end is no outcome
        if not len(at):
            return None
        heads_at = at[places.word_ends(at) | is_stop[at]]
        hashes = places.heads(heads_at)
        hit = known(hashes)
        found = [hashes[hit] | places.ends[heads_at[hit]]]
        for k in ORDERS:  # a context ends a text only if each shorter one does
            hashes = places.hashes(at, at - k, k)
            hit = known(hashes)
            at = at[hit]
            found.append(hashes[hit] | places.ends[at])
        keys = np.sort(np.concatenate(found))
        if not len(keys):
            return None
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        value, n = keys[edges], np.diff(np.append(edges, len(keys)))
        same = np.flatnonzero(np.concatenate([[True], (value[1:] & _EVEN) != (value[:-1] & _EVEN)]))
        ended = n * (value & np.uint64(1)).astype(np.int64)
        return (value[same] & _EVEN).view(np.int64), np.add.reduceat(n, same), np.add.reduceat(ended, same)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        shift = np.uint64(64 - (len(bitmap) - 1).bit_length())
        known = lambda hashes: ((bitmap[(hashes >> shift).astype(np.int64)] >> (hashes & np.uint64(63))) & np.uint64(1)).astype(bool)
        held: dict[str, list[tuple]] = {}
        size = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n, e = _counts(*(np.concatenate(x) for x in zip(*parts)))
                of = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int32)), pa.array([lang])).cast(pa.string())
                for i in range(0, len(keys), 65536):
                    part = slice(i, i + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part]), of.slice(i, 65536), pa.array(n[part]), pa.array(e[part])], ["key", "lang", "n", "e"])
            held.clear()

        for batch in batches:
            of_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                of_lang.setdefault(lang, []).append(text)
            for lang, texts in of_lang.items():
                for first, stop in _portions(texts):
                    if found := outcomes(texts[first:stop], known):
                        held.setdefault(lang, []).append(found)
                        size += len(found[0])
                if size > HELD:
                    yield from handed_on()
                    size = 0
        yield from handed_on()

    texts = documents.select(language(F.col("lang")).alias("lang"), "text").filter("text is not null and text <> ''")
    one = texts.mapInArrow(counted, "key bigint, lang string, n bigint, e bigint").repartition("key").groupBy("key", "lang").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    return one.groupBy("key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.collect_list(F.struct("lang", "n", "e")).alias("by_lang"))


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, score): the log-odds that a unit ends where the text ends."""
    finals = stage(final_contexts(documents), "final-contexts")
    counts = context_counts(documents, finals)
    one = F.when(F.col("marked"), 0).otherwise(1)
    copies = finals.groupBy("text_hash", "lang").agg(F.sum(one).alias("own_lang"), F.any_value("keys").alias("keys"))
    own = finals.groupBy("text_hash").agg(F.sum(one).alias("own"))
    exploded = copies.select("text_hash", "lang", F.posexplode("keys").alias("k", "key"))
    in_lang = F.get(F.filter("by_lang", lambda x: x["lang"] == F.col("lang")), 0)
    joined = exploded.join(counts, "key").select("text_hash", "lang", F.struct("k", "n", "e", in_lang["n"].alias("n_lang"), in_lang["e"].alias("e_lang")).alias("x"))
    seen = joined.groupBy("text_hash", "lang").agg(F.collect_list("x").alias("seen"))
    judged = copies.drop("keys").join(own, "text_hash").join(seen, ["text_hash", "lang"], "left")
    in_order = F.array_sort(F.coalesce("seen", F.array().cast("array<struct<k:int,n:bigint,e:bigint,n_lang:bigint,e_lang:bigint>>")))

    def pulled(p: Column, e: Column, n: Column, minus: Column) -> Column:
        rest = lambda x: F.greatest(x - minus, F.lit(0))
        return (rest(e) + F.lit(PULL) * p) / (rest(n) + F.lit(PULL))

    def blended(p: Column, x: Column) -> Column:
        n, e = F.coalesce(x["n_lang"], F.lit(0)), F.coalesce(x["e_lang"], F.lit(0))
        others = pulled(p, x["e"] - e, x["n"] - n, F.col("own") - F.col("own_lang"))
        return pulled(others, e, n, F.col("own_lang"))

    blend = F.aggregate(F.filter(in_order, lambda x: x["k"] < len(ORDERS)), F.lit(0.02), blended)
    head = F.aggregate(F.filter(in_order, lambda x: x["k"] == len(ORDERS)), F.lit(0.1), blended)

    def odds(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(q / (1 - q))

    evidence = F.least(F.greatest(odds(head) - math.log(0.1 / 0.9), F.lit(HEAD_BOUNDS[0])), F.lit(HEAD_BOUNDS[1]))
    by_text = judged.select("text_hash", "lang", odds(blend).alias("contexts"), evidence.alias("head"))
    marked = F.when(F.col("marked"), F.lit(MARKED)).otherwise(F.lit(0.0))
    return finals.join(by_text, ["text_hash", "lang"]).select("doc_id", "lang", "source", "contexts", "head", "marked", (F.col("contexts") + F.col("head") - marked).alias("score"))


def thresholds(scores: DataFrame) -> dict[str | None, float]:
    """By language (None: all), the emptiest place of the scores near zero.

    Each language's histogram is shrunk towards that of all languages by ``PRIOR_TEXTS``, whatever its size.
    Only a histogram comes to the driver: at most a few dozen bins for each language.
    """
    low, high = GAP_RANGE
    bins = F.floor((F.col("score") - low) / GAP_STEP).cast("int")
    rows = scores.groupBy("lang", F.greatest(F.lit(-1), F.least(bins, F.lit(int((high - low) / GAP_STEP)))).alias("bin")).count().collect()
    total: dict[str | None, np.ndarray] = {}
    size = int((high - low) / GAP_STEP)
    for r in rows:
        for lang in (r["lang"], None):
            total.setdefault(lang, np.zeros(size + 2, np.int64))[r["bin"] + 1] += r["count"]

    def gap(counts: np.ndarray) -> float:
        inner = counts[1:-1]
        around = np.convolve(np.pad(inner, 1, mode="edge"), [1, 2, 1], "valid")
        middle = low + GAP_STEP * (np.arange(size) + 0.5)
        return float(middle[min(range(size), key=lambda i: (around[i], abs(middle[i] + 1)))])

    if not total:
        return {}
    prior = total[None] * (PRIOR_TEXTS / total[None].sum())
    return {lang: gap(c + prior) for lang, c in total.items()}


def cut_off(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, score, cut) of each text that is not blank."""
    scores = stage(scored(documents), "end-scores")
    limit = thresholds(scores)
    general = limit.pop(None, -1.0)
    threshold = F.lit(general)
    for lang, value in sorted((x, v) for x, v in limit.items() if v != general):
        threshold = F.when(F.col("lang") == lang, F.lit(value)).otherwise(threshold)
    return scores.withColumn("cut", F.col("score") < threshold)


def cut_shares(documents: DataFrame, judged: DataFrame) -> DataFrame:
    """Per source: texts (null and empty ones included), texts cut off, and their share."""
    all_rows = documents.groupBy("source").agg(F.count("*").alias("n_documents"))
    cut = judged.filter("cut").groupBy("source").agg(F.count("*").alias("n_cut"))
    joined = all_rows.join(cut, all_rows["source"].eqNullSafe(cut["source"]), "left").select(all_rows["source"], "n_documents", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return joined.withColumn("share", F.round(F.col("n_cut") / F.col("n_documents"), 6))
