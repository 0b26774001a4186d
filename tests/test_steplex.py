"""The STEP lexer against small cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brepflow.functions import steplex as S


def body(*statements: str) -> str:
    return "DATA;\n" + "\n".join(statements) + "\nENDSEC;\nEND-ISO-10303-21;"


def unresolved(text: str) -> list[tuple[int, int]]:
    sources, targets, defined = S.references(text)
    return sorted((n, m) for n, m in zip(sources, targets) if m not in defined)


def test_unresolved_counts_forward_references_comments_and_literals():
    text = body("#1=A(#2,#9);", "/* #2=NOT(#77); */", "#0002 = B('#55; ''#56''',#1);", "#3=C(#00009,\n#4);", "#4=D(#9)")
    assert unresolved(text) == [(1, 9), (3, 4), (3, 9)]


def test_header_statements_do_not_define():
    assert unresolved("ISO-10303-21;\nHEADER;\n#5=X();\nENDSEC;\n" + body("#1=A(#5);")) == [(1, 5)]


@pytest.mark.parametrize("text", ["", "DATA;", "DATA;ENDSEC;", "'", "/*", body(), "\x00", "DATA;\n#1=A(#1);"])
def test_odd_texts_have_no_orphans(text):
    assert unresolved(text) == []
    assert S.file_references(text) == []


def test_file_references_read_the_first_argument():
    text = body("#1=document_file('0000_00000007','',$);", "#2 = DOCUMENT_FILE ( 'it''s' , #1);", "#3=X('DOCUMENT_FILE(''a'')');", "/* #4=DOCUMENT_FILE('z'); */", "#5=DOCUMENT_FILE($);")
    assert S.file_references(text) == [(1, "0000_00000007"), (2, "it's")]


def plain_bare(text: str) -> str:
    """Literals and comments taken off character by character."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "'":
            out.append("'")
            i += 1
            while i < len(text) and (text[i] != "'" or text[i : i + 2] == "''"):
                i += 2 if text[i] == "'" else 1
            i += 1
        elif text[i : i + 2] == "/*":
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(["'", "''", "/*", "*/", "/", "*", "a;", " ", "#1=B("]), max_size=14).map("".join))
def test_bare_texts(text):
    assert S.bare(text) == plain_bare(text)


def test_sections_by_keyword_only():
    text = "ISO;\nXDATA; #9=Z();\ndata ('a',(1)) ; #1=A();\nEndSec ;\n#8=Y(); DATA;#2=B();"
    assert "".join(S.data_body(text).split()) == "#1=A();#2=B();"
    assert S.data_body("ß DATA;#1=A(ß);ENDSEC;") == "#1=A(ß);"
