"""Recall and precision on the documents themselves, cut at random places."""

import os
import random
from collections import Counter

import pytest

from brepflow.llm import truncation
from brepflow.session import table

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_cuts_at_random_places(spark):
    documents = table(spark, FOLDER, "documents").select("doc_id", "text", "lang", "source")
    flagged = {r.doc_id for r in truncation.cut_off(documents).filter("cut").collect()}  # cut as they came: neither hits nor misses
    rnd, cut, rows = random.Random(1), set(), []
    for doc_id, text, lang, source in documents.orderBy("doc_id").collect():
        if text and doc_id not in flagged and len(text) > 60 and rnd.random() < 0.05:
            places = [i for i in rnd.sample(range(30, len(text)), 8) if not text[i - 1].isspace() and text[i - 1] not in ".!?。！？;:|" and text[i] not in ".!?。！？;\n"]
            if places:  # not where a sentence, line or statement ends
                cut.add(doc_id)
                text = text[: places[0]]
        rows.append((doc_id, text, lang, source))
    judged = truncation.cut_off(spark.createDataFrame(rows, documents.schema).repartition(4)).collect()
    planted, hits, false = Counter(), Counter(), Counter()
    for r in judged:
        if r.doc_id in cut:
            planted[r.lang] += 1
            hits[r.lang] += r.cut
        elif r.cut and r.doc_id not in flagged:
            false[r.lang] += 1
    assert planted.total() > 300
    assert hits.total() / planted.total() >= 0.95 and hits.total() / (hits.total() + false.total()) >= 0.95
    for lang, n in planted.items():
        if n >= 20:
            assert hits[lang] / n >= 0.9 and hits[lang] / (hits[lang] + false[lang]) >= 0.95, lang


def test_rare_languages_back_off_and_labels_count(spark):
    """A language of two texts is judged by the counts of all; the copies in each language by its own."""
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")  # noqa: E731  no two texts are copies
    rows = [(i, f"The {name(i)} was redrawn in steel and then measured twice by hand", "en", "s") for i in range(300)]
    rows += [(1000, "The bracket was redrawn in steel and then mea", "xx", "s"), (1001, "The flange was redrawn in steel and then measured twice by hand", " XX", "s")]
    t = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    score = {r.doc_id: (r.lang, r.score) for r in truncation.scored(t).filter("doc_id >= 1000").collect()}
    assert score[1000][0] == score[1001][0] == "xx" and score[1000][1] < -2 < 1 < score[1001][1]


def test_contexts_without_places_in_the_own_language(spark):
    """Where a mark ends the only text of a language, no place of that language is counted."""
    rows = [(i, "The bracket was made by hand.", "en", "s") for i in range(20)] + [(99, "The bracket was m [...]", "yy", "s")]
    t = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id for r in truncation.cut_off(t).filter("cut").collect()} == {99}
