"""Epoch lines of documents without a source."""

import __spark_entry__ as entry
from brepflow.sources import files as S

def test_logs_without_a_source_keep_their_lines(spark, small, duck, tmp_path):
    text = duck.execute("select text from documents where source = 'training_log' and regexp_matches(text, ?) limit 1", [S.EPOCH_LINE]).fetchone()[0]
    rows = [(2, text, None), (3, text, "training_log"), (5, "no epoch", None), (7, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    lines = got("s17_epoch_lines")
    assert {r.doc_id for r in lines} == {2, 3}
    of = {r.epoch for r in lines}
    assert {r.epoch for r in got("j09_common_epochs")} == of == {r.epoch for r in got("o08_epoch_intersection")}
    assert {r.doc_id for r in got("a21_error_bars")} == {2, 3}
