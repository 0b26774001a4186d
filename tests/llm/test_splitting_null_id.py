"""Pieces of a value whose row has no id."""

from brepflow.llm import splitting as S


def test_pieces_of_a_null_id(spark):
    long = "".join(f"#{i}=P({i});" for i in range(200))
    values = S.oversized(spark.createDataFrame([(None, long), (1, long)], "row_id bigint, step string"), {"step": (150, 0)})
    got = {}
    for r in S.pieces(values).orderBy("piece_no").collect():
        got[r.row_id] = got.get(r.row_id, "") + r.text
    assert got == {None: long, 1: long}
