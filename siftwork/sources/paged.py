"""A paged row service as a resumable Spark source (S-4).

A service gives rows by offset and length, such as a dataset viewer's ``rows`` call.  As a
batch source its rows are dealt to tasks by ranges of pages; as a stream source the offset
reached is kept in the query's checkpoint, so a scan that was stopped or has failed goes on
where its last finished micro-batch ended: no row is lost and none is read into the sink twice.

The caller gives two functions, which travel to the tasks: ``fetch(offset, length)`` returns the
rows of one page as dictionaries, ``total()`` the number of rows there are now.  A page
that comes back shorter than asked is an error, not an end, unless it is the last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGE = 100
Fetch = Callable[[int, int], list[dict]]


@dataclass
class Pages(InputPartition):
    start: int
    end: int


def dealt(start: int, end: int, page: int, pages: int) -> list[Pages]:
    """The rows from ``start`` to ``end`` in ranges of ``pages`` pages."""
    step = page * pages
    return [Pages(i, min(i + step, end)) for i in range(start, end, step)]


def rows_of(part: Pages, fetch: Fetch, page: int, schema: StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    for at in range(part.start, part.end, page):
        asked = min(page, part.end - at)
        rows = fetch(at, asked)
        if len(rows) != asked:
            raise OSError(f"{len(rows)} of {asked} rows at {at}")
        yield pa.RecordBatch.from_pylist(rows, arrow)


def paged_source(name: str, schema: str, fetch: Fetch, total: Callable[[], int], page: int = PAGE, pages: int = 10,
                 batch_pages: int | None = None) -> type[DataSource]:
    """A data source ``name`` over the service: ``pages`` pages a task, and in a stream at most
    ``batch_pages`` pages a micro-batch (default: all there are)."""
    class Batch(DataSourceReader):
        def __init__(self, struct: StructType) -> None:
            self.struct = struct

        def partitions(self) -> list[Pages]:
            return dealt(0, total(), page, pages)

        def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
            return rows_of(partition, fetch, page, self.struct)

    class Stream(DataSourceStreamReader):
        def __init__(self, struct: StructType) -> None:
            self.struct, self.reached = struct, 0

        def initialOffset(self) -> dict:
            return {"row": 0}

        def latestOffset(self) -> dict:
            there = total()
            self.reached = there if batch_pages is None else min(there, self.reached + page * batch_pages)
            return {"row": self.reached}

        def partitions(self, start: dict, end: dict) -> list[Pages]:
            self.reached = max(self.reached, end["row"])
            return dealt(start["row"], end["row"], page, pages)

        def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
            return rows_of(partition, fetch, page, self.struct)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Batch(schema)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return Stream(schema)

    return Source


def register_paged(spark: SparkSession, name: str, schema: str, fetch: Fetch, total: Callable[[], int], **dealing) -> str:
    """Make the service known as format ``name`` of ``spark.read`` and ``spark.readStream``."""
    spark.dataSource.register(paged_source(name, schema, fetch, total, **dealing))
    return name
