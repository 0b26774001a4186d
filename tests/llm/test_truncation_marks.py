"""Marks in place of the rest, whatever white space follows them."""

import pytest

from brepflow.llm import truncation as T


@pytest.mark.parametrize("mark", ["…", "...", ".....", "[...]", "( … )", "[" + " " * 40 + "...]", "." * 50])
@pytest.mark.parametrize("after", ["", " ", " " * 31, "\n" * 60, " \t\r\n" * 20])
def test_mark_is_taken_off(mark, after):
    assert T.folded("the left brac " + mark + after) == ("the left brac", True)


@pytest.mark.parametrize("text", ["The end.", "a..", "[....]", "…]", "(...]", ""])
def test_no_mark(text):
    assert T.folded(text + " " * 40) == (text, False)
