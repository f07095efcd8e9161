"""A paged service read in parallel, and a scan that is stopped and goes on."""

import os

import pytest

from siftwork.operators import domains as dom
from siftwork.sources.paged import dealt, register_paged
from siftwork.streaming import stream as ST

SCHEMA = "row_idx long, row struct<domain:string>"


def service(folder, fails_at=None):
    """Rows from a counter; ``folder/total`` says how many there are, ``folder/repaired`` ends a fault."""
    def fetch(offset, length):
        if fails_at is not None and offset <= fails_at < offset + length and not os.path.exists(f"{folder}/repaired"):
            raise OSError("service down")
        return [{"row_idx": i, "row": {"domain": f"www.math{i % 50}.edu" if i % 7 else None}} for i in range(offset, offset + length)]

    def total():
        with open(f"{folder}/total") as f:
            return int(f.read())

    return fetch, total


def test_ranges():
    assert [(p.start, p.end) for p in dealt(250, 777, 100, 2)] == [(250, 450), (450, 650), (650, 777)]
    assert dealt(5, 5, 100, 2) == []


def test_batch_read(spark, tmp_path):
    (tmp_path / "total").write_text("1234")
    fetch, total = service(str(tmp_path))
    name = register_paged(spark, "pages_batch", SCHEMA, fetch, total, pages=3)
    df = spark.read.format(name).load()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(r.row_idx for r in df.collect()) == list(range(1234))
    cleaned = dom.distinct_domains(dom.cleaned_domains(df.selectExpr("row_idx AS row_id", "row.domain AS domain")))
    assert cleaned.count() == 50


@pytest.mark.parametrize("batch_pages", [None, 4])
def test_restarted_scan_neither_loses_nor_repeats(spark, tmp_path, batch_pages):
    (tmp_path / "total").write_text("950")
    fetch, total = service(str(tmp_path), fails_at=1500)
    name = register_paged(spark, f"pages_stream_{batch_pages}", SCHEMA, fetch, total, pages=2, batch_pages=batch_pages)
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "checkpoint")

    def scan():
        while True:
            progress = ST.append_to(spark.readStream.format(name).load(), sink, checkpoint)
            if not any(p["numInputRows"] for p in progress):
                return sorted(r.row_idx for r in spark.read.schema(SCHEMA).parquet(sink).collect())

    assert scan() == list(range(950))
    (tmp_path / "total").write_text("2100")
    with pytest.raises(Exception, match="service down"):
        scan()
    (tmp_path / "repaired").write_text("")
    assert scan() == list(range(2100))
    assert scan() == list(range(2100))
