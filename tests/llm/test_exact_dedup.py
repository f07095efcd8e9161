import hashlib

from pyspark.sql import functions as F

from siftwork.llm import exact_dedup as E

from .conftest import odd_texts


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check(df, **params):
    rows = df.collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    got = E.exact_dedup(df, **params).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (max(known) if known else None) and r.group_size == len(ids)
        kept.setdefault(r.text_sha256, []).append(r.doc_id) if r.kept else None
    assert {k: v[0] for k, v in kept.items()} == {k: max((i for i in v if i is not None), default=None)
                                                  for k, v in by_sha.items()}
    assert all(len(v) == 1 for v in kept.values())
    stays = E.keep_one(df)
    assert stays.columns == df.columns and stays.count() == len(groups)


def test_odd_texts(docs):
    check(docs(odd_texts()))


def test_copies_and_near_copies(docs):
    base = ". ".join(f"sentence number {i} says {i * 7919 % 1000}" for i in range(400))
    rows = [(i, base) for i in range(40)] + [(100 + i, base[:i * 50] + "X" + base[i * 50:]) for i in range(40)]
    rows += [(200 + i, base.upper()) for i in range(5)]
    check(docs(rows))


def test_chunks_that_share_fingerprints(docs):
    few = lambda chunk: F.pmod(F.length(chunk), F.lit(3)).cast("long")
    base = ". ".join(f"sentence {i} of many" for i in range(200))
    check(docs([*odd_texts(), *[(300 + i, base + "y" * (i % 4)) for i in range(12)]]), fingerprint=few)


def test_chunks_follow_content(spark):
    a = ". ".join(f"some words {i} and more words {i * i}" for i in range(600))
    df = spark.createDataFrame([(a,), ("z" * 700 + ". " + a,)], "t string")
    one, two = [set(r[0]) for r in df.select(E.chunks(F.col("t"))).collect()]
    assert "".join(df.select(E.chunks(F.col("t"))).first()[0]) == a
    assert len(one & two) > 0.8 * len(one)


def test_empty_table(docs):
    assert E.exact_dedup(docs([])).count() == 0 and E.keep_one(docs([])).count() == 0
