import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """rows -> DataFrame with the columns of documents and two clashing extra ones."""
    def make(rows, parts=3):
        full = [(*r, *([None] * (5 - len(r))), "extra", 1) for r in rows]
        schema = T._parse_datatype_string(DOCS + ", kept string, component_id int")
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


def odd_texts():
    """Null, empty, white space, one word, ties, very long, control strings, non-ASCII, repeated rows."""
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", "en", "a"), (4, "one", "en", "b"),
        (5, "ONE", "fr", "b"), (6, "a b c d", None, "a"), (7, "A B C D", "de", None), (8, "é É ß ẞ İ 東京 \x85   x", "fr", "c"),
        (9, long_text, "en", "c"), (10, long_text, "en", "c"), (11, "<|endoftext|> x <|im_end|>", "es", "d"),
        (12, "x" * 20_000, "en", "a"), (13, "don't 'll ''s  'S  a\n\n b 12 3four5 \x1c\x1d z", "en", "a"),
        (13, "don't 'll ''s  'S  a\n\n b 12 3four5 \x1c\x1d z", "en", "a"), (None, "no id here", "en", "b"),
        (None, "one", "en", "b"), (14, "12345 67 !! ..", "en", "e"),
    ]
