"""Encoding against the tokenizer's own libraries; packing within its rules."""

import os
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brepflow.llm import bpe, packing

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZERS), reason="no tokenizers")
ODD = [
    None, "", " ", "  a  b\n\n c\t", "don't I'll <|endoftext|> x", "\x1c\x1d\x85   a b", "a" * 700, "日本語" * 60, "é é ﬀ ½ ²³ ٣", "\U0001f600" * 40,
    "x" * 300 + " " * 300, "\n", "\x00\x01", "0123456789" * 30, "aaa aaaa aaaaa", "#1=P('',(1.5E-3,2.));",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/{bpe.NAME}.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids if x else []


def test_odd_texts(library):
    assert bpe.encoder(bpe.TOKENIZERS, bpe.NAME)(ODD) == [library(x) for x in ODD]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert bpe.encoder(bpe.TOKENIZERS, bpe.NAME)([text])[0] == packing._counter(bpe.TOKENIZERS, bpe.NAME).encode_ordinary(text)


def test_few_steps_at_a_time_give_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "ROWS", 40)
    fresh = bpe.Encoder(bpe.TOKENIZERS, bpe.NAME)
    texts = ["internationalization of the straightforward", "a" * 300, "日本語" * 20, "ababababab" * 9]
    assert fresh(texts) == [library(x) for x in texts]


def test_table(spark, library):
    t = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(ODD)] + [(0, "twice", ""), (0, "twice", "")], "doc_id bigint, text string, ids string")
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.token_ids(t).collect())
    assert got == Counter((i, tuple(library(x))) for i, x in [*enumerate(ODD), (0, "twice"), (0, "twice")])
    assert bpe.token_ids(t.limit(0)).count() == 0


def items(spark, n, hot=0):
    rng = np.random.default_rng(4)
    rows = [(i, ["s", "t", None][i % 3], i, int(s)) for i, s in enumerate(np.minimum(rng.geometric(0.004, n), 2500))]
    rows += [(n + i, "s", -1, 40) for i in range(hot)] + [(None, None, -2, 10), (None, None, -2, 10)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, cluster bigint, size int"), rows


@pytest.mark.parametrize("hot", [0, 60, 2000])
def test_packing(spark, hot):
    t, rows = items(spark, 4000, hot)
    cap = 1000
    placed = packing.pack(t, cap, group_items=1500).collect()
    load, clusters = Counter(), defaultdict(Counter)
    of = {r[0]: r[2] for r in rows}
    for p in placed:
        load[p.container_id] += p.n_tokens
        clusters[p.container_id][of[p.doc_id]] += 1
    assert max(load.values()) <= cap
    assert sum(load.values()) == sum(r[3] for r in rows)
    several = Counter(p.doc_id for p in placed)
    size = {r[0]: r[3] for r in rows}
    assert all(n == 1 or d is None or size[d] > cap for d, n in several.items())
    assert sum(load.values()) / (cap * len(load)) > 0.98
    if hot == 60:  # copies of a text never share a container
        assert max(c[-1] for c in clusters.values()) == 1


def test_apart_sources_do_not_meet():
    sizes = np.array([50, 50, 50, 50])
    place = packing.best_fit(sizes, np.arange(4), np.array([0, 1, 0, 1]), 100, {0: 2, 1: 1})
    assert place[0] == place[2] != place[1] == place[3]


def test_best_fit_takes_the_tightest():
    assert packing.best_fit(np.array([60, 70, 30, 40]), np.arange(4), np.zeros(4, int), 100).tolist() == [0, 1, 1, 0]


def test_sizes_leave_out_nothing_and_empty(spark):
    t = spark.createDataFrame([(1, "s", "hello world"), (2, "s", None), (3, "s", ""), (4, None, " ")], "doc_id bigint, source string, text string")
    assert {r.doc_id: r.size for r in packing.sized(t).collect()} == {1: 2, 4: 1}
    assert packing.pack(packing.sized(t.limit(0)), 10).count() == 0


@pytest.mark.parametrize("word", ["a" * 100_000, "-" * 100_001, "aab" * 30_000, "=-" * 50_001, "é" * 20_001, " " * 50_000 + "x"], ids=lambda w: w[:4])
def test_long_runs_take_few_steps(word, library):
    """A run of equal pairs is halved in one step; one step a pair would take minutes."""
    began = time.perf_counter()
    assert bpe.encoder(bpe.TOKENIZERS, bpe.NAME)([word])[0] == library(word)
    assert time.perf_counter() - began < 20


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab-= ", min_size=1, max_size=80))
def test_runs_equal_the_library(text):
    assert bpe.encoder(bpe.TOKENIZERS, bpe.NAME)([text])[0] == packing._counter(bpe.TOKENIZERS, bpe.NAME).encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=60))
def test_any_ascii_text(text):
    assert bpe.encoder(bpe.TOKENIZERS, bpe.NAME)([text])[0] == packing._counter(bpe.TOKENIZERS, bpe.NAME).encode_ordinary(text)
