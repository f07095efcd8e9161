"""Web-page quality and coherence scores (0-10) as column expressions.

All arithmetic is done in doubles in the same order as the reference rules so
that results are bit-identical; terms that do not apply add ``0.0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD_RUN, WS, col_, count_contains, count_substr, py_strip, word_count

# Fixed values that must equal the reference rules.
WEB_TECH_KEYWORDS = ["react", "javascript", "python", "api", "component", "function", "method"]
WEB_MIN_WORDS = 100
WEB_MAX_WORDS = 5000


def _clamp(score: Column, lo: float = 0.0, hi: float = 10.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), score))


def web_quality_inputs(content: Column | str, title: Column | str, prefix: str = "_q") -> dict[str, Column]:
    """Per-row counters the quality score needs; stage them as columns (one
    regex scan each) and combine with :func:`web_quality_from`."""
    content = F.coalesce(col_(content), F.lit(""))
    title = col_(title)
    lower = F.lower(content)
    return {
        f"{prefix}wc": word_count(content),
        # words of content.split('.') pieces = runs of characters that are neither blank nor '.'
        f"{prefix}sw": F.regexp_count(content, F.lit(WORD_RUN.replace("]+", ".]+"))).cast("int"),
        f"{prefix}dots": count_substr(content, "."),
        f"{prefix}bangs": count_substr(content, "!"),
        f"{prefix}title": title.isNotNull() & (F.length(title) > 10),
        f"{prefix}code": content.contains("```") | content.contains("<code>") | lower.contains("function"),
        f"{prefix}kw": count_contains(lower, WEB_TECH_KEYWORDS),
    }


def web_quality_from(prefix: str = "_q", min_words: int = WEB_MIN_WORDS, max_words: int = WEB_MAX_WORDS) -> Column:
    """P-18 from staged counters (see :func:`web_quality_inputs`)."""
    c = lambda n: F.col(f"{prefix}{n}")
    wc = c("wc")
    score = F.lit(5.0)
    score = score + F.when(wc.between(min_words, max_words), F.lit(1.0)).when(wc < min_words, F.lit(-2.0)).otherwise(F.lit(0.0))
    score = score + F.when(c("title"), F.lit(0.5)).otherwise(F.lit(0.0))
    score = score + F.when(c("code"), F.lit(1.0)).otherwise(F.lit(0.0))
    score = score + F.least(c("kw") * F.lit(0.3), F.lit(1.5))
    # sentences = content.split('.'): n = count('.') + 1, words summed over pieces.
    avg_sentence = c("sw") / (c("dots") + 1)
    score = score + F.when((avg_sentence >= 10) & (avg_sentence <= 25), F.lit(0.5)).otherwise(F.lit(0.0))
    score = score + F.when(c("bangs") > wc * F.lit(0.05), F.lit(-1.0)).otherwise(F.lit(0.0))
    return _clamp(score)


def with_repeated_terms(df: DataFrame, content: str, out: str = "repeated_terms") -> DataFrame:
    """Adds the number of distinct lower-case tokens longer than 4 characters
    occurring at least 3 times in the row (A-15).

    Computed inside the row on a sorted token array: no explode, no shuffle.
    The sorted array is staged in its own projection so the lambda reads it
    instead of re-sorting per element.
    """
    tmp = f"__{out}_sorted"
    staged = df.withColumn(
        tmp,
        # after the strip, splitting on blank runs leaves no empty token except for
        # an empty text, and the length filter drops that one
        F.sort_array(F.filter(F.split(py_strip(F.lower(F.coalesce(F.col(content), F.lit("")))), f"{WS}+"),
                              lambda x: F.length(x) > 4)),
    )
    s = F.col(tmp)
    third = F.filter(
        s,
        lambda x, i: (i >= 2) & (x == F.get(s, i - 2)) & ((i < 3) | (F.get(s, i - 3) != x)),
    )
    return staged.withColumn(out, F.size(third)).drop(tmp)


def web_coherence_inputs(content: Column | str, prefix: str = "_c") -> dict[str, Column]:
    content = F.coalesce(col_(content), F.lit(""))
    return {
        # >= 2 non-blank '\n\n' paragraphs <=> the stripped text still holds a blank line
        f"{prefix}para": py_strip(content).contains("\n\n"),
        f"{prefix}dots": count_substr(content, "."),
    }


def _coherence(paragraphs: Column, dots: Column, repeated_terms: Column | str) -> Column:
    repeated = F.least(col_(repeated_terms) * F.lit(0.2), F.lit(1.0))
    return _clamp(F.lit(5.0) + F.when(paragraphs, F.lit(1.0)).otherwise(F.lit(0.0))
                  + F.when(dots >= 3, repeated).otherwise(F.lit(0.0)))


def web_coherence_from(repeated_terms: Column | str, prefix: str = "_c") -> Column:
    """Coherence 0-10 (P-19) from staged inputs."""
    return _coherence(F.col(f"{prefix}para"), F.col(f"{prefix}dots"), repeated_terms)


def web_coherence_score(content: Column | str, repeated_terms: Column | str) -> Column:
    """Coherence 0-10 (P-19) given the A-15 count for the same content."""
    inputs = web_coherence_inputs(content, "")
    return _coherence(inputs["para"], inputs["dots"], repeated_terms)


__all__ = ["WS", "with_repeated_terms", "web_coherence_score", "WEB_TECH_KEYWORDS"]
