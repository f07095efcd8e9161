"""The history index against a plain anti join, and what it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.sources import history as H


def test_filters_forget_nothing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 10, 20_000):
        held, other = (rng.integers(-(1 << 63), 1 << 63, size, dtype=np.int64) for size in (n, 20_000))
        bits = H.bloom(held)
        assert H.knows(bits, held).all()
        assert H.knows(bits, other).mean() < 0.03 and len(bits) <= max(8, 1.25 * n + 1)


@pytest.mark.parametrize("buckets, slices", [(256, 4096), (4, 8)])
def test_same_rows_as_the_anti_join(spark, tmp_path, buckets, slices):
    path = str(tmp_path / "index")
    rows = spark.range(2000).select(F.concat(F.lit("k"), F.col("id") % 700).alias("k"), F.col("id").alias("n")).unionByName(
        spark.createDataFrame([(None, -1), ("", -2)], "k string, n long"))
    assert H.unseen(rows, "k", path, buckets, slices).count() == 2002
    added = spark.createDataFrame([], "k string")
    for run in range(2 if buckets == 4 else 3):
        new = spark.range(run * 40, run * 40 + 60).select(F.concat(F.lit("k"), F.col("id") * 5).alias("k")).unionByName(
            spark.createDataFrame([(None,), ("",)] if run == 1 else [], "k string"))
        H.add_keys(new.unionByName(new), "k", path, buckets, slices)
        added = added.unionByName(new)
        want = rows.join(added, "k", "left_anti")
        got = H.unseen(rows, "k", path, buckets, slices)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_history_is_read_for_suspects_only(spark, tmp_path):
    path = str(tmp_path / "index")
    H.add_keys(spark.range(5000).select(F.concat(F.lit("old"), "id").alias("k")), "k", path)
    new = spark.range(50).select(F.concat(F.lit("new"), "id").alias("k"))
    maybe = H.suspects(new, "k", path)
    assert maybe.count() <= 5
    plan = H.unseen(new.unionByName(spark.createDataFrame([("old7",)], "k string")), "k", path)._jdf.queryExecution().toString()
    at = plan.index("PartitionFilters: [", plan.index("Physical Plan"))
    assert "bucket" in plan[at:at + 200]


def test_a_lost_run_has_added_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    H.add_keys(spark.createDataFrame([("a",)], "k string"), "k", path)

    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(H, "write_filters", lost)
    with pytest.raises(KeyboardInterrupt):
        H.add_keys(spark.createDataFrame([("b",)], "k string"), "k", path)
    monkeypatch.undo()
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert sorted(r.k for r in H.unseen(rows, "k", path).collect()) == ["b", "c"]
