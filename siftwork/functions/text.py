"""Whitespace-exact text primitives as Catalyst expressions.

Python's ``str.split()`` / ``str.strip()`` treat more code points as blanks
than Java's ``\\s``.  ``WS`` below matches exactly Python's set (U+0009-000D,
U+001C-001F, U+0020, U+0085 and the Unicode ``Z`` categories), so word counts
and strips agree with the reference semantics while staying JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One blank character, Java regex syntax.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
# One run of non-blank characters (a "word" for str.split()).
WORD_RUN = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()`` with Python's whitespace set."""
    return F.regexp_replace(col_(c), f"^{WS}+|{WS}+$", "")


def py_split(c: Column | str) -> Column:
    """``str.split()``: tokens between blank runs, no empty tokens."""
    return F.filter(F.split(py_strip(c), f"{WS}+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    """``len(text.split())`` without materialising the token array."""
    return F.regexp_count(F.coalesce(col_(c), F.lit("")), F.lit(WORD_RUN)).cast("int")


def collapse_ws(c: Column | str) -> Column:
    """``re.sub(r'\\s+', ' ', text)`` with Python's whitespace set."""
    return F.regexp_replace(col_(c), f"{WS}+", " ")


def count_substr(c: Column | str, sub: str) -> Column:
    """``text.count(sub)`` for a literal, non-overlapping substring."""
    c = col_(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("int")


def any_contains(c: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | c.contains(w)
    return cond


def count_contains(c: Column, words) -> Column:
    """How many of ``words`` occur in ``c`` (substring semantics)."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(c.contains(w), 1).otherwise(0)
    return total


def lines(c: Column | str) -> Column:
    """``text.split('\\n')`` (empties kept)."""
    return F.split(col_(c), "\n")


def md5_prefix(c: Column, n: int = 12) -> Column:
    """First ``n`` hex characters of the MD5 of a string (stable ids)."""
    return F.substring(F.md5(c), 1, n)


def fence(df):
    """Projection fence: re-emits each row through a one-element generator.

    Catalyst pushes filters below projections by inlining the projected
    expressions, so a filter on a column derived from an expensive per-row
    expression (HTML extraction) would evaluate that expression again inside
    the filter.  Generator outputs cannot be inlined, so filters stop here and
    the expensive projection runs exactly once per row.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))
