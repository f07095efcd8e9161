"""Files whose extension has no complexity are not scanned for it, and score 0."""

from pyspark.sql import functions as F

from siftwork.functions import codescore as C


def test_only_scored_extensions_are_scanned(spark):
    text = "class A\nfunction f\n\nif x"
    df = spark.createDataFrame([(".py", text), (".JS", text), (".md", text), (None, text), (".py", None)], "ext string, content string")
    inputs = C.complexity_inputs("content", "ext")
    rows = df.select(*[c.alias(n) for n, c in inputs.items()]).collect()
    assert [tuple(r) for r in rows] == [(3, 1, 1, 1), (3, 1, 1, 1), (None,) * 4, (None,) * 4, (0, 0, 0, 0)]
    scores = [r.s for r in df.withColumns(inputs).select(C.complexity_from(F.lower("ext")).alias("s")).collect()]
    assert scores == [10.0, 10.0, 0.0, 0.0, 0.0]
