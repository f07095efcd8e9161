import hashlib
import re

import pytest

from siftwork.llm import decontamination as D

from .conftest import odd_texts

BENCH = "item_id string, text string, lang string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text, items, size):
    have, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if n else 0):
            for at in range(len(have) - n + 1):
                if have[at:at + n] == w[i:i + n]:
                    hit.update(range(at, at + n))
                    found.add(item)
    found = sorted(x for x in found if x is not None)
    return len(have), hit, found


def check(spark, docs, rows, items, size=10, block=D.BLOCK):
    df = docs(rows)
    bench = spark.createDataFrame([(*i, "x") for i in items], BENCH)
    got = D.contaminated(df, bench, size=size, block=block).collect()
    want = []
    for r in rows:
        n, hit, found = by_hand(r[1], items, size)
        want.append((r[0], n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    for r in got:
        assert sum(s.end - s.start for s in r.spans or []) == r.n_hit
    return df, bench


ITEMS = [("a", "One two THREE four five six seven"), ("b", "two, three: four! five six"), ("b", "é x2 東京"), (None, "w3x3 w4x4"),
         ("c", None), ("d", "..."), ("e", "alpha beta gamma"), ("a,e", "beta gamma"), ("long", " ".join(f"v{i}" for i in range(40)))]


@pytest.mark.parametrize("size, block", [(10, D.BLOCK), (3, D.BLOCK), (3, 4), (1, 7)])
def test_against_all_windows(spark, docs, size, block):
    v = [f"v{i}" for i in range(40)]
    rows = [*[r for r in odd_texts() if len(r[1] or "") < 50_000],
            (30, "say one Two three-four five; six seven eight"), (31, " ".join(v[5:30]) + " and " + " ".join(v[:9])),
            (32, "é X2 東京 w3x3 w4x4"), (33, "alpha beta gamma alpha beta gamma"), (33, "beta gamma"), (34, " ".join(v * 3))]
    check(spark, docs, rows, ITEMS, size, block)


def test_very_long_text(spark, docs):
    check(spark, docs, [r for r in odd_texts() if r[0] in (9, 12)], [("a", "w976x7 w0x8 w1x9"), ("b", "no such words")], 3)


def test_removal(spark, docs):
    rows = [(1, "Keep this. One two three four five six SEVEN! And this\n", "en", "a"), (2, "clean text", "en", "a"),
            (3, None, "en", "a"), (4, "one two three four five six seven", "en", "b"), (4, "one two", "en", "b"),
            (5, "a one two three four five six seven b One two three four five six seven. c?", "en", "b")]
    df, bench = check(spark, docs, rows, ITEMS[:1])
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect())) == [
        (1, "Keep this! And this\n"), (2, "clean text"), (3, ""), (4, ""), (4, "one two"), (5, "a b. c?")]
    whole = D.decontaminate(df, bench, remove="documents")
    assert sorted((r.doc_id, r.text or "") for r in whole.collect()) == [(2, "clean text"), (3, ""), (4, "one two")]


def test_clashing_columns(spark, docs):
    df = docs([(1, "one two three four five six seven x")])
    for name in ("rid", "row", "words", "spans", "len", "class", "h", "item", "sha", "of_len", "at", "own"):
        df = df.withColumn(name, df.doc_id * 2)
    bench = spark.createDataFrame([(*ITEMS[0], "x")], BENCH).selectExpr("*", "1 AS h", "2 AS items", "3 AS words", "4 AS class")
    assert D.contaminated(df, bench).first().n_hit == 7
    out = D.decontaminate(df, bench)
    assert out.columns == df.columns and out.first().text == " x" and out.first().rid == 2


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], BENCH)
    assert D.contaminated(docs([]), none).count() == 0
    got = D.contaminated(docs(odd_texts()), none).collect()
    assert len(got) == len(odd_texts()) and not any(r.contaminated for r in got)
    assert D.decontaminate(docs(odd_texts()), none).count() == len(odd_texts())
