import re

import pytest

from siftwork.llm import divergence as V

from .conftest import odd_texts


def by_hand(rows, least, top=10):
    terms = lambda t: [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(r[2] or "", r[3] or "", terms(r[1])) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        every = {t for d in mine for t in d[2]}
        kept = sorted(t for t in every if sum(t in d[2] for d in mine) >= least)

        def shares(texts):
            n = {t: sum(x.count(t) for x in texts) for t in kept}
            total = sum(n.values())
            return n, {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares([d[2] for d in mine])[1]
        sources = sorted({d[1] for d in mine})
        of = {s: shares([d[2] for d in mine if d[1] == s]) for s in sources}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            n, p = of[s]
            pairs = [(-sum(f(p[t], of[o][1][t]) for t in kept), o) for o in sources if o != s]
            over = [(-f(p[t], whole[t]), t) for t in kept if n[t] and p[t] > whole[t]]
            key = lambda x: (x[0], x[1].encode())
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pairs, key=key), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(sorted(over, key=key)[:top], 1)]
    return out


LOWER = {c: c + 32 for c in range(65, 91)}


def check(docs, rows, **params):
    got = [tuple(r) for r in V.divergence(docs(rows), **params).collect()]
    want = by_hand(rows, params.get("least", 10), params.get("top", 10))
    assert sorted(got) == sorted(want)
    return got


@pytest.mark.parametrize("least", [1, 2, 10])
def test_odd_texts(docs, least):
    check(docs, odd_texts(), least=least)


@pytest.mark.parametrize("terms, tile", [(4096, 64), (3, 2), (1, 1)])
def test_blocks_and_tiles(docs, terms, tile):
    rows = [(i, " ".join(f"{c}{'x' * (i * k % 5)} É" for k, c in enumerate("abcdefgh") if (i + k) % 3),
             ("en", "de", None)[i % 3], f"s{i * i % 11}") for i in range(150)]
    rows += [(900, "123", "en", "empty"), (901, None, "xx", "p"), (902, "", "xx", "q")]
    got = check(docs, rows, terms=terms, tile=tile)
    assert ("xx", "p", "pair", "q", 0, 1) in got and any(r[1] == "empty" for r in got)


def test_repeated_flushes(docs, monkeypatch):
    monkeypatch.setattr(V, "ENTRIES", 5)
    check(docs, [(i, f"one two three t{chr(97 + i % 20)}", "en", f"s{i % 4}") for i in range(120)])


def test_share_of_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (10**15, 3 * 10**15, 10**6), (10**12, 10**12, 1), (7, 10**10, 12345)]
    df = spark.createDataFrame(cases, "n long, total long, v long")
    got = [r[0] for r in df.select(V.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in cases]


def test_empty_and_clashing_columns(docs):
    assert V.divergence(docs([])).count() == 0
    df = docs(odd_texts())
    want = V.divergence(df, least=2).collect()
    for name in ("term", "n", "d", "g", "v", "many", "p0", "part", "item", "value", "rank", "ln"):
        df = df.withColumn(name, df.doc_id * 2)
    assert sorted(V.divergence(df, least=2).collect()) == sorted(want)
