"""Orphan references against brute force, and their defined cases."""

import datetime as dt
import random

from brepflow.operators import orphans as O

T0 = dt.datetime(2024, 1, 1)
TRAIN = "row_id bigint, ingested_at timestamp_ntz, step string, uid string, extra int"
FILES = "uid string, recorded_at timestamp_ntz, removed_at timestamp_ntz, target string"


def step(*s: str) -> str:
    return "DATA;\n" + "\n".join(s) + "\nENDSEC;"


def test_presence_matches_brute_force(spark):
    rnd = random.Random(3)
    at = lambda: T0 + dt.timedelta(hours=rnd.randrange(24 * 40))
    uids = ["hot"] * 5 + ["a", "b", "c"]
    intervals = [(rnd.choice(uids), at(), rnd.choice([None, at()])) for _ in range(120)] + [("hot", None, at()), (None, at(), None)]
    keys = [(rnd.choice([*uids, "none"]), at()) for _ in range(300)]
    i = spark.createDataFrame(intervals, "uid string, start timestamp_ntz, end timestamp_ntz")
    k = spark.createDataFrame(keys, "uid string, at timestamp_ntz")
    got = {tuple(r) for r in O.present_keys(k, i).collect()}
    want = {(u, t) for u, t in keys if any(u == v and s is not None and s <= t and (e is None or t < e) for v, s, e in intervals)}
    assert got == want


def test_orphans_and_counts(spark):
    rows = [
        (1, T0, step("#1=A(#2);", "#3=DOCUMENT_FILE('0000_00000001','',$);", "#4=DOCUMENT_FILE('0000/00000002');"), "u", 1),
        (1, T0, step("#1=A(#2);", "#3=DOCUMENT_FILE('0000_00000001','',$);", "#4=DOCUMENT_FILE('0000/00000002');"), "u", 1),
        (2, None, step("#1=DOCUMENT_FILE('0000/00000001');"), None, None),
        (3, T0 + dt.timedelta(days=40), step("#1=DOCUMENT_FILE('0000/00000001');", "#2=DOCUMENT_FILE('no uid');"), "v", 2),
        (4, T0, None, "w", 3), (5, T0, "", "x", 4), (6, T0, step("#1=X('" + "a" * 200_000 + "',#2);"), "y", 5),
    ]
    files = [("0000_00000001", T0, T0 + dt.timedelta(days=1), "clash"), ("0000/00000001", T0, T0 + dt.timedelta(days=1), "clash")]
    found = O.orphan_references(spark.createDataFrame(rows, TRAIN), spark.createDataFrame(files, FILES))
    got = {(r.row_id, r.src_eid, r.target) for r in found.collect()}
    assert got == {(1, 1, "#2"), (1, 4, "0000/00000002"), (2, 1, "0000/00000001"), (3, 1, "0000/00000001"), (6, 1, "#2")}
    counts = {(r.referred_table, r.month): (r.n_orphans, r.n_rows) for r in O.orphan_counts(found).collect()}
    assert counts[(O.INSTANCE, "2024-01")] == (2, 2)
    assert counts[(O.FILE, None)] == (1, 1)


def test_empty_tables(spark):
    found = O.orphan_references(spark.createDataFrame([], TRAIN), spark.createDataFrame([], FILES))
    assert found.count() == 0 and O.orphan_counts(found).count() == 0


def test_every_file_reference_is_an_orphan_without_files(spark):
    rows = [(1, T0, step("#1=DOCUMENT_FILE('a/b');"), "u", 1)]
    found = O.orphan_references(spark.createDataFrame(rows, TRAIN), spark.createDataFrame([], FILES))
    assert [r.target for r in found.collect()] == ["a/b"]
