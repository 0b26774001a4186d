"""Lexing of STEP (ISO 10303-21) text for Arrow-batched workers.

Every function works on whole texts with a handful of C-level regular-expression passes;
nothing here walks characters or statements one by one in Python unless a record needs it.

Defined cases
-------------
* ``None`` and empty texts have no statements.
* A literal or comment that is never closed runs to the end of the text.
* A text without a ``DATA;`` keyword is taken as the body of a DATA section.
* A last statement without its ``;`` is not a statement.
"""

from __future__ import annotations

import re
from itertools import repeat

#: A literal (with doubled quotes) or a comment; the group keeps one quote of a literal.
LITERAL_OR_COMMENT = re.compile(r"(')[^']*(?:''[^']*)*(?:'|\Z)|/\*.*?(?:\*/|\Z)", re.S)
_COMMENT_ONLY = re.compile(r"('[^']*(?:''[^']*)*(?:'|\Z))|/\*.*?(?:\*/|\Z)", re.S)
_DATA, _ENDSEC = re.compile(r"DATA\s*(?:\([^;]*\)\s*)?;"), re.compile(r"ENDSEC\s*;")
_START_REF_OR_STOP = re.compile(r"(?:\A|(?<=;))#(\d+)=|#(\d+)(?!\d*=)|;")
_FILE_STATEMENT = re.compile(
    r"(?:\A|(?<=;))\s*#\s*(\d+)\s*=\s*DOCUMENT_FILE\s*\(\s*'([^']*(?:''[^']*)*)'", re.I
)


def _found(upper: str, word: str, rest: re.Pattern, at: int) -> re.Match | None:
    """The next keyword that stands at the start, or after a ``;`` or white space, and goes on as ``rest`` says."""
    i = upper.find(word, at)
    while i >= 0:
        if (not i or upper[i - 1] == ";" or upper[i - 1].isspace()) and (m := rest.match(upper, i)):
            return m
        i = upper.find(word, i + 1)
    return None


def data_body(masked: str) -> str:
    """The DATA sections of a text whose literals and comments are masked; the text itself where there is none."""
    upper = masked.upper()
    if len(upper) != len(masked):  # characters of several capitals: places would not agree
        upper = "".join(c if len(u := c.upper()) != 1 else u for c in masked)
    parts: list[str] = []
    at = 0
    while opens := _found(upper, "DATA", _DATA, at):
        closes = _found(upper, "ENDSEC", _ENDSEC, opens.end())
        parts.append(masked[opens.end() : closes.start() if closes else len(masked)])
        if not closes:
            break
        at = closes.end()
    return "".join(parts) if parts else masked


def bare(text: str) -> str:
    """The text without comments and literal contents; one quote stays of each literal."""
    if "/*" in text:
        return LITERAL_OR_COMMENT.sub(r"\1", text)
    parts = text.split("'")  # what lies outside literals is at the even places, but for doubled quotes
    out = "'".join(parts[::2]) + ("'" if len(parts) % 2 == 0 else "")
    while "''" in out:
        out = out.replace("''", "'")
    return out


def compact(text: str) -> str:
    """The DATA statements without literal contents, comments and white space."""
    return "".join(data_body(bare(text)).split())


def references(text: str) -> tuple[list[int], list[int], list[int]]:
    """The distinct (statement, instance referred to) pairs of a text as two lists, and the instances its statements define."""
    pairs: list[tuple[str, str]] = []
    defined: list[str] = []
    eid, held = "", []
    for start, ref in _START_REF_OR_STOP.findall(compact(text)):
        if ref:
            held.append(ref)
        elif start:
            eid = start
        else:  # the statement ends
            if eid:
                defined.append(eid)
                pairs += zip(repeat(eid), held)
            eid, held = "", []
    distinct = {(int(n), int(m)) for n, m in set(pairs)}
    return [n for n, _ in distinct], [m for _, m in distinct], list(map(int, defined))


def _literal_placeholders(text: str) -> tuple[str, list[str]]:
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        if m.group(1) is None:
            return ""
        kept.append(m.group(1))
        return f"'{len(kept) - 1}'"

    return _COMMENT_ONLY.sub(keep, text), kept


def file_references(text: str) -> list[tuple[int, str]]:
    """(statement, first argument) of each DOCUMENT_FILE statement; a non-literal argument is none."""
    if "DOCUMENT_FILE" not in text.upper():
        return []
    masked, kept = _literal_placeholders(text)
    out = []
    for part in data_body(masked).split(";")[:-1]:
        if m := _FILE_STATEMENT.match(part):
            name = kept[int(m.group(2))]
            out.append((int(m.group(1)), name[1:-1].replace("''", "'") if name.endswith("'") else name[1:]))
    return out
