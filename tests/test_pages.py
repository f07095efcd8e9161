"""Page extraction passes its results on in small steps, so a task's memory does not follow Spark's batches."""

import pyarrow as pa

from siftwork.operators import pages


def test_a_large_batch_is_read_in_steps():
    n = 3 * pages.STEP + 5
    batch = pa.RecordBatch.from_pydict({
        "page_id": pa.array(range(n)),
        "html": pa.array([None if i == 7 else f"<title>t{i}</title><main>m{i}<code>c{i}</code></main>" for i in range(n)])})
    got = list(pages.read_batches(iter([batch]), ["page_id"], "html", ["page_id", "title", "_text", "_codes"]))
    assert [b.num_rows for b in got] == [pages.STEP] * 3 + [5]
    rows = pa.Table.from_batches(got).to_pylist()
    assert [r["page_id"] for r in rows] == list(range(n))
    assert rows[7] == {"page_id": 7, "title": "", "_text": "", "_codes": []}
    assert rows[n - 1] == {"page_id": n - 1, "title": f"t{n - 1}", "_text": f"m{n - 1} __CODE_BLOCK_0__", "_codes": [f"c{n - 1}"]}


def test_pages_of_many_steps(spark):
    n = 2 * pages.STEP + 3
    df = spark.createDataFrame([(i, f"<title>t{i}</title><main>some text {i}</main>") for i in range(n)], "page_id long, html string")
    got = {r.page_id: (r.title, r.content) for r in pages.extract_pages(df.coalesce(1)).collect()}
    assert got == {i: (f"t{i}", f"some text {i}") for i in range(n)}
