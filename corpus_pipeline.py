"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage gets the Parquet that its predecessor wrote, works on all of it, and
returns the columns of documents; the last returns the packed pieces.  Nulls, empty
and very long texts, ties and repeated rows have the results that the operators
state.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import exact_dedup, language_id, mixing, ngram_join, packing
from siftwork.session import staged
from siftwork.sources.tables import read_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go.  Those in none of the learned languages stay, as
    their scores are almost never at the level of chance."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z case) the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles (similarity 0.75 or more) the one with the
    smallest doc_id stays."""
    return ngram_join.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or up to three times."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", drop_exact_copies),
    ("near_duplicates", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language ID, mixing offsets and packing are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
