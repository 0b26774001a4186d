"""Splitting: stitched ranges equal a plain scan; pieces keep the limits and the whole value."""

from hypothesis import given, settings
from hypothesis import strategies as st

from brepflow.llm import splitting as S


def plain_ends(text):
    ends, state, i = [], "code", 0
    while i < len(text):
        two = text[i : i + 2]
        if state == "code":
            if text[i] == "'":
                state = "literal"
            elif two == "/*":
                state, i = "comment", i + 1
            elif text[i] == ";":
                ends.append(i + 1)
        elif state == "literal":
            state = "code" if text[i] == "'" else "literal"
        elif two == "*/":
            state, i = "code", i + 1
        i += 1
    return ends


def stitched(text, size):
    """Statement ends and length in characters, from ranges of some bytes that know nothing of each other."""
    data = text.encode()
    state, chars, ends = S.CODE, 0, []
    for begin in range(0, len(data), size):
        n = min(size, len(data) - begin)
        length, after, found = S.boundaries(data[begin : begin + n + 1], n, begin == 0)
        here = found[state] if found[state] is not None else found[S._PLAIN[state]]
        ends += [chars + int(e) for e in here]
        state, chars = after[state], chars + length
    return ends, chars


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=";'/*abé😀", max_size=60), st.integers(1, 12))
def test_stitched_equals_plain(text, size):
    assert stitched(text, size) == (plain_ends(text), len(text))


@settings(max_examples=500, deadline=None)
@given(st.sets(st.integers(1, 120), max_size=30), st.integers(1, 120), st.integers(1, 50), st.integers(0, 60), st.integers(1, 40))
def test_pieces_laid_range_by_range_are_the_same(ends, length, max_size, overlap, step):
    ends = sorted(e for e in ends if e <= length)
    pieces, rows = S.Pieces(max_size, overlap), []
    for known in range(step, length + step, step):
        pieces.feed([e for e in ends if known - step < e <= known], min(known, length), known >= length)
        rows += pieces.taken()
    assert rows == S.lay(ends, length, max_size, overlap)


@settings(max_examples=500, deadline=None)
@given(st.sets(st.integers(1, 120), max_size=30), st.integers(1, 120), st.integers(1, 50), st.integers(0, 60))
def test_pieces_keep_limits(ends, length, max_size, overlap):
    ends = sorted(e for e in ends if e <= length)
    done = 0
    for start, end, repeated in S.lay(ends, length, max_size, overlap):
        assert end - start <= max_size and start + repeated == done < end and repeated <= overlap
        assert not repeated or (done in ends and (start in ends or start == 0))
        if end < length and end not in ends:
            assert not any(done < e <= done + max_size for e in ends)
        done = end
    assert done == length


def test_pieces_of_a_table(spark):
    statements = [f"#{i}=P('; {i} é😀',(1.,{i}.));" for i in range(9000)]
    long = "DATA;\n" + "\n".join(statements) + "\nENDSEC;"
    rows = [(1, long, long, "x"), (1, long, None, "y"), (2, "short;", "a" * 250, "z"), (3, None, "", "w"), (4, "'" + "; " * 200, "b;" * 100, "v")]
    t = spark.createDataFrame(rows, "row_id bigint, step string, retrieved_step string, h string")
    values = S.oversized(t, {"step": (150, 60), "retrieved_step": (200, 30)})
    got = {}
    for r in S.pieces(values).collect():
        assert len(r.text) == r.n_chars <= (150 if r.field == "step" else 200)
        got.setdefault((r.row_id, r.field), []).append(r)
    whole = {(1, "step"): long, (1, "retrieved_step"): long, (2, "retrieved_step"): "a" * 250, (4, "step"): "'" + "; " * 200}
    assert set(got) == set(whole)
    for key, pieces in got.items():
        pieces.sort(key=lambda r: r.piece_no)
        assert [p.piece_no for p in pieces] == list(range(1, pieces[0].n_pieces + 1))
        assert "".join(p.text[p.n_repeated :] for p in pieces) == whole[key]
    assert S.cut_table(S.oversized(t.limit(0), {"step": (150, 60)})).count() == 0


def test_files_are_split_by_ranges(spark, tmp_path):
    """Pieces of files equal those of the same texts in a table, whatever the ranges; bad UTF-8 loses nothing."""
    from brepflow.sources import files

    texts = {"a.step": "DATA;\n" + "\n".join(f"#{i}=P('; é {i}😀');/* ; */" for i in range(400)), "b.step": "'" + "ü;" * 300, "c.step": "short;", "d.step": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "e.step").write_bytes(b"\x80\x80" + b"x\xff;" * 100)
    spans = S.of_files(files.listed(spark, str(tmp_path)), 130, 40)
    for size in (7, 64, 1000, S.RANGE):
        got = {}
        for r in S.pieces(spans, size).collect():
            got.setdefault(r.field[-6:], []).append(r)
        assert set(got) == {"a.step", "b.step", "e.step"}
        for name, pieces in got.items():
            pieces.sort(key=lambda r: r.piece_no)
            assert all(len(p.text) >= p.n_chars and p.n_chars <= 130 for p in pieces)
            if name in texts:
                assert "".join(p.text[p.n_repeated :] for p in pieces) == texts[name]
                assert [(p.start, p.start + p.n_chars, p.n_repeated) for p in pieces] == S.lay(plain_ends(texts[name]), len(texts[name]), 130, 40)
        assert pieces[-1].n_pieces == len(pieces)
