"""Cleaning of extracted page text and code blocks as column expressions (P-13, P-14).

The text comes from :mod:`.htmlregion` with a mark in place of each code block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, collapse_ws, py_strip


def clean_text_formatting(text: Column) -> Column:
    """P-14: whitespace, punctuation spacing, adjacent repeated-word removal.

    After the first pass every blank run is a single U+0020, so the later
    passes match a plain space instead of the Unicode blank class.
    """
    t = collapse_ws(text)
    t = F.regexp_replace(t, r" *([.!?]) *", "$1 ")
    t = F.regexp_replace(t, r" *([,;:]) *", "$1 ")
    t = F.regexp_replace(t, r" *\| *", " | ")
    t = F.regexp_replace(t, r" *> *", " > ")
    # W-13: drop a word longer than 3 that repeats its predecessor case-insensitively:
    # a token followed by one or more space-separated copies of itself -> the token
    t = F.regexp_replace(t, r"(?iu)(?<![^ ])([^ ]{4,})(?: +\1(?![^ ]))++", "$1")
    return F.trim(F.regexp_replace(t, " +", " "))


def fenced_code(code: Column) -> Column:
    """P-13: a code block stripped, without blank lines, between fences."""
    lines = F.regexp_replace(py_strip(code), rf"\n{WS}*\n", "\n")
    return F.concat(F.lit("\n\n```\n"), lines, F.lit("\n```\n\n"))


def with_code(cleaned: Column, codes: Column) -> Column:
    """P-13: the code blocks put back where their marks stand in the cleaned text."""
    pieces = F.split(cleaned, r"__CODE_BLOCK_\d+__")
    blocks = F.concat(F.array(F.lit("")), F.transform(codes, fenced_code))
    joined = F.array_join(F.zip_with(pieces, blocks, lambda p, b: F.concat(F.coalesce(b, F.lit("")), p)), "")
    return F.when(F.size(codes) == 0, cleaned).otherwise(py_strip(joined))
