"""Truncation: held-out accuracy on texts cut on purpose, and the defined cases."""

import random

from brepflow.llm import truncation as T

SCHEMA = "doc_id bigint, text string, lang string, source string, score string"
NOUNS = "bracket hinge flange bezel housing collar shaft gasket".split()
FORMS = [
    "The second reviewer compared both {} views and found the {} shifted by {:.3f} mm.", "Please keep the {} at {:.1f} degrees and don't touch the {} before the next morning.",
    "We measured a mesh density of {:.2f} for the {}, which is slightly below the {} we planned.", "Training on the wide {} lowered the loss from {:.3f} in {} runs.",
]


def sentence(rnd):
    f = rnd.choice(FORMS)
    return f.format(*(rnd.uniform(1, 300) if f.split("{")[k + 1].startswith(":") else rnd.choice(NOUNS) for k in range(f.count("{"))))


def corpus(seed, n=1500):
    rnd = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(sentence(rnd) for _ in range(rnd.randrange(2, 7)))
        if rnd.random() < 0.2:
            text += rnd.choice(["\n\nStatus: open", "\n\n-- mould desk"])
        elif rnd.random() < 0.1:
            text = text[:-1]
        if rnd.random() < 0.12:
            at = rnd.randrange(len(text) // 2, len(text) - 25)
            while not (text[at - 1].isalpha() and text[at].isalpha()):
                at -= 1
            text, _ = text[:at] + rnd.choice(["", "", "…", " [...]"]), cut.add(i)
        rows.append((i, text, rnd.choice(["en", "EN", None]), rnd.choice(["a", "b", None]), "clash"))
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = corpus(11)
    rows += [(9000, None, "en", "a", ""), (9001, "", "en", "a", ""), (9002, " \n ", None, None, "")]
    t = spark.createDataFrame(rows, SCHEMA)
    judged = T.cut_off(t)
    got = {r.doc_id for r in judged.filter("cut").collect()}
    hit = len(got & cut)
    assert hit / len(cut) >= 0.95 and hit / len(got) >= 0.95
    shares = {r.source: (r.n_documents, r.n_cut) for r in T.cut_shares(t, judged).collect()}
    assert sum(n for n, _ in shares.values()) == len(rows) and sum(c for _, c in shares.values()) == len(got)


def test_copies_are_judged_alike_and_do_not_vouch_for_each_other(spark):
    rows, _ = corpus(12, 800)
    rows += [(5000 + i, "We measured a mesh density of 12.5 for the bez", "en", "a", "") for i in range(6)]
    got = {r.doc_id: r.cut for r in T.cut_off(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[5000 + i] for i in range(6))


def test_empty_table(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert T.cut_off(t).count() == 0 and T.cut_shares(t, T.cut_off(t)).count() == 0


def test_very_long_text(spark):
    rows, _ = corpus(13, 300)
    rows.append((7000, "x" * 300_000, "en", "a", ""))
    assert T.cut_off(spark.createDataFrame(rows, SCHEMA)).count() == 301
