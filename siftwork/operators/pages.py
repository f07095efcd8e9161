"""Page extraction: raw HTML rows -> (title, content) rows.

Spark partitions the pages; each task reads them with the event parser in Arrow
batches (nested and unclosed elements are beyond regular expressions), and the
cleaning that follows is column expressions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import htmlregion
from ..functions.html import clean_text_formatting, with_code
from ..functions.text import fence

# Worker code travels with the task (by value): executors need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(htmlregion)

#: Pages whose results a task holds before it passes them on, whatever the size of Spark's batches.
STEP = 128


def read_batches(batches: Iterator[pa.RecordBatch], keep: list[str], html: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns to keep, with title, text and code blocks of each page, ``STEP`` pages at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, STEP):
            part = batch.slice(first, STEP)
            read = [htmlregion.read_page(h.as_py()) for h in part.column(html)]
            found = [pa.array([r[0] for r in read], pa.string()), pa.array([r[1] for r in read], pa.string()),
                     pa.array([r[2] for r in read], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + found, names)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``title`` (P-11) and ``content`` (P-12/13/14); drops the HTML."""
    keep = [c for c in pages.columns if c != html]
    schema = StructType([pages.schema[c] for c in keep] + [
        StructField("title", StringType()), StructField("_text", StringType()),
        StructField("_codes", ArrayType(StringType()))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read_batches(batches, keep, html, names)

    staged = pages.select(*keep, html).mapInArrow(run, schema)
    staged = staged.withColumn("_clean", clean_text_formatting(F.col("_text")))
    return fence(staged.select(*keep, "title", with_code(F.col("_clean"), F.col("_codes")).alias("content")))
