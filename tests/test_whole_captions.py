"""Token rows are those of whole texts, headers behind any length included."""

import __spark_entry__ as entry

HEAD = b"### output:\n"


def test_headers_behind_long_captions_are_found(spark, tmp_path):
    rows = [(1, "ü" * 900, "some text"), (2, "a b", None), (17, "", ""), (4, None, "x")]
    spark.createDataFrame(rows, "row_id bigint, caption string, retrieved_caption string").write.parquet(f"{tmp_path}/train_with_rag.parquet")
    got = lambda name: {r[0]: r[1] for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    long = list("ü".encode() * 900 + b"\n" + HEAD + b"some text")
    k = 1800 + 1 + len(HEAD)
    assert got("k02_after_header") == {1: k, 2: -1, 17: 1 + len(HEAD)}
    assert got("k03_labels") == {1: [-100] * k + long[k:], 2: [-100] * 3, 17: [-100] * 13}
    assert got("k04_truncated") == {1: long[:512], 2: list(b"a b"), 17: list(b"\n" + HEAD)}
    assert got("k05_padded") == {1: long, 2: list(b"a b") + [0] * (len(long) - 3), 17: list(b"\n" + HEAD)}
    assert got("k06_generation_budget") == {1: 256, 2: 957, 17: 947}
    assert got("a23_unmasked_share") == {1: round(9 / len(long), 6), 2: 0.0, 17: 0.0}


def test_counts_by_a_library_and_bounds(spark):
    from pyspark.sql import functions as F

    from brepflow.operators import corpus, tokens

    t = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "a " * 50)], "row_id bigint, text string")
    words = tokens.counter(lambda: lambda text: len(text.split()))
    assert {r[0]: r[1] for r in t.select("row_id", words(F.col("text"))).collect()} == {1: 3, 2: None, 3: 0, 4: 50}
    assert {r.row_id for r in corpus.within_tokens(t, F.col("text"), 49, words).collect()} == {1, 3}


def test_shuffle_is_stable_and_no_order_of_keys(spark):
    from brepflow.operators import corpus

    t = spark.createDataFrame([(f"u{i:03d}",) for i in range(200)], "uid string")
    one, two = ([r.uid for r in corpus.shuffled(x).collect()] for x in (t, t.repartition(7)))
    assert one == two != sorted(one) and sorted(one) == [f"u{i:03d}" for i in range(200)]


def test_texts_are_cut_between_characters(spark):
    from pyspark.sql import functions as F

    from brepflow.operators import tokens

    t = spark.createDataFrame([("aé😀b",), ("",), (None,), ("😀",)], "x string")
    for most, wanted in ((0, ["", "", None, ""]), (2, ["a", "", None, ""]), (3, ["aé", "", None, ""]), (6, ["aé", "", None, "😀"]), (7, ["aé😀", "", None, "😀"]), (99, ["aé😀b", "", None, "😀"])):
        assert [r.c for r in t.select(tokens.cut_text(F.col("x"), most).alias("c")).collect()] == wanted
