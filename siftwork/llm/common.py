"""Shared pieces: word rule, staged tables, packed shuffle rows, worker caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Words are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else.  ``lower`` is exact on pure ASCII and far
    cheaper than ``translate``, which only texts with other characters need."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def crc_of(col: str) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def held_out(col: str, modulus: int, remainder: int = 2) -> Column:
    """crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.pmod(crc_of(col), F.lit(modulus)) == remainder, F.lit(False))


def whole_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """Each row as one struct ``row`` beside the named columns, so that no name of a
    caller's column meets one of an operator's; ``select("row.*")`` gives it back."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column: sizes packed shards before a shuffle."""
    return df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0


def worker_cache(owner: str) -> dict:
    """Values kept by one Python worker between the tasks of one operator; another
    operator's are let go, so that a worker never holds the stores of several."""
    import sys
    import types

    name = "_siftwork_llm_worker"
    module = sys.modules.setdefault(name, types.ModuleType(name))
    if getattr(module, "owner", None) != owner:
        module.owner, module.kept = owner, {}
    return module.kept
