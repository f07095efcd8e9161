"""Judge-output parsing (P-29, P-30) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, py_strip

# Fixed values that must equal the reference rules (checked in this order).
SCORE_KEYS = ["RELEVANCE", "ACCURACY", "COMPLETENESS", "CLARITY", "SPECIFICITY", "OVERALL", "REASON"]
DIMENSIONS = ["relevance", "accuracy", "completeness", "clarity", "specificity"]


def line_score(line: Column) -> Column:
    """P-30: first number on the line clamped to 1..10; no number -> 0."""
    num = F.regexp_extract(line, r"\d+\.?\d*", 0)
    val = num.try_cast("double")
    return F.when((num == "") | val.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(1.0), val)))


def _line_key(line: Column) -> Column:
    key = F.lit(None).cast("string")
    for k in reversed(SCORE_KEYS):
        key = F.when(line.contains(f"{k}:"), F.lit(k)).otherwise(key)
    return key


def keyed_lines(text: Column | str) -> Column:
    """Upper-cased, stripped lines, each tagged with the first key it contains."""
    lines = F.transform(F.split(F.upper(F.coalesce(col_(text), F.lit(""))), "\n"), lambda l: py_strip(l))
    return F.filter(F.transform(lines, lambda l: F.struct(_line_key(l).alias("k"), l.alias("l"))),
                    lambda x: x["k"].isNotNull())


def parse_scores(keyed: Column) -> Column:
    """P-29 from :func:`keyed_lines` output: struct of the five dimensions,
    overall and reason; the last line per key wins, absent keys score 0."""
    def last_line(k):
        return F.try_element_at(F.filter(keyed, lambda x: x["k"] == k), F.lit(-1))["l"]

    fields = {}
    for k in SCORE_KEYS[:-1]:
        ln = last_line(k)
        fields[k.lower()] = F.when(ln.isNull(), F.lit(0.0)).otherwise(line_score(ln))
    reason_line = last_line("REASON")
    fields["reason"] = F.coalesce(py_strip(F.replace(reason_line, F.lit("REASON:"), F.lit(""))), F.lit(""))
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def fill_overall(scores: Column) -> Column:
    """Overall = given value, else mean of positive dimensions (1 decimal, half-even)."""
    dims = [scores[d] for d in DIMENSIONS]
    total = F.lit(0.0)
    n = F.lit(0)
    for d in dims:
        total = total + F.when(d > 0, d).otherwise(F.lit(0.0))
        n = n + F.when(d > 0, 1).otherwise(0)
    mean = F.when(n > 0, F.bround(total / n, 1)).otherwise(F.lit(0.0))
    return F.when(scores["overall"] == 0, mean).otherwise(scores["overall"])
