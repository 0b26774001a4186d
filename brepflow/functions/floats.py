"""Exact float normalisation in STEP texts (T13, T14): Arrow-batched, outside literals.

Spark's ``format_string`` rounds halves away from zero; Python rounds the binary value, keeps
``-0.000000`` and may give a mantissa of ``10.000000``. The latter is what is wanted.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_REAL = r"-?(?:\d+\.\d*|\.\d+)(?:[Ee][+-]?\d+)?"
_LITERAL = r"'[^']*(?:''[^']*)*'"
#: Cuts a text into what is kept and, at the odd places, literals and reals (with the ``#`` before them, where that guards them).
_CUT = {True: re.compile(f"({_LITERAL}|#?{_REAL})"), False: re.compile(f"({_LITERAL}|{_REAL})")}
#: Numbers that a process remembers; forgetting costs time only.
_MEMO_MOST = 500_000
_memo: dict[str, str] = {}


def _normal(token: str) -> str:
    """A real at six decimals, its exponent kept; literals and guarded reals as they are."""
    if token[0] in "'#":
        return token
    found = _memo.get(token)
    if found is None:
        mantissa, mark, exponent = token.replace("e", "E").partition("E")
        if len(_memo) >= _MEMO_MOST:
            _memo.clear()
        found = _memo[token] = f"{round(float(mantissa), 6):.6f}" + mark + exponent
    return found


def normalise(text: str, guard: bool = True) -> str:
    """Each real at six decimals, its exponent kept. With ``guard``, not directly after ``#``. Numbers repeat, so each is formatted once."""
    parts = _CUT[guard].split(text)
    parts[1::2] = map(_normal, parts[1::2])
    return "".join(parts)


def _udf(guard: bool):
    def rounded(text: pd.Series) -> pd.Series:
        return text.map(lambda t: normalise(t, guard), na_action="ignore")

    return F.pandas_udf(rounded, "string")


def round_floats(text: Column) -> Column:
    """T13"""
    return _udf(True)(text)


def round_floats_unguarded(text: Column) -> Column:
    """T14"""
    return _udf(False)(text)
