from itertools import permutations

import numpy as np

from siftwork.llm import filter_audit as A

from .conftest import odd_texts

LABELS = "doc_id long, quality int, toxic int, part string"


def fails(rows):
    out = []
    for i, t in ((r[0], r[1] or "") for r in rows):
        w = t.split(" ") if "\n" not in t and "\t" not in t else t.replace("\n", " ").replace("\t", " ").split(" ")
        for c in "\x0b\x0c\r":
            w = [y for x in w for y in x.split(c)]
        w = [x for x in w if x]
        out.append((len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                    any(c in "#$%&*|" for c in t),
                    i is not None and any(s[0] is not None and s[0] < i and (s[1] or "") == t for s in rows)))
    return out


def by_hand(rows, labels):
    failed = fails(rows)
    good = {l[0] for l in labels if l[1] == 1 and l[0] is not None}
    toxic = {l[0] for l in labels if l[2] == 1 and l[0] is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            gone = set()
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                here = [n for n, (_, f) in enumerate(docs) if f[k] and n not in gone]
                redundant = sum(f[k] for _, f in docs) - len(here)
                gone |= set(here)
                shapley[letter] += len(here)
                out[part, "".join(order), step] = [
                    len(docs) - len(gone), len(here), redundant, sum(f[k] and sum(f) == 1 for _, f in docs),
                    sum(docs[n][0] in good for n in here), sum(docs[n][0] in toxic for n in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def check(spark, docs, rows, labels):
    got = A.audit(docs(rows), spark.createDataFrame([(*l, "x") for l in labels], LABELS)).collect()
    want = by_hand(rows, labels)
    assert len(got) == len(want)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[
            r.part, r.filter_order, r.step]


def test_odd_texts(spark, docs):
    labels = [(1, 1, 0), (2, None, 1), (9, 1, None), (9, 0, 1), (10, 1, 1), (13, 1, 1), (None, 1, 1), (777, 1, 1), (8, 2, 0)]
    check(spark, docs, odd_texts(), labels)


def test_all_combinations_and_copies(spark, docs):
    rows = []
    for bits in range(16):
        words = [f"w{bits}x{i % 7 if bits & 2 else i}" for i in range(20 if bits & 1 else 130)]
        text = " ".join(w.upper() if bits & 4 else w for w in words) + (" #" if bits & 8 else "")
        rows += [(100 * bits + k, text, ("en", "fr", None)[k % 3], "s") for k in range(1 + bits % 4)]
    check(spark, docs, rows, [(r[0], r[0] % 2, r[0] % 3 == 0 and 1 or 0) for r in rows[::2]])


def test_positional_counts():
    words = np.random.default_rng(1).integers(0, 1 << 32, 1001, dtype=np.uint32)
    for n in (0, 1, 2, 3, 4, 5, 8, 64, 1001):
        want = [int(((words[:n] >> np.uint32(b)) & 1).sum()) for b in range(32)]
        assert A.positional_counts(words[:n]).tolist() == want


def test_survival_words():
    table = A.survival_words()
    for failed in range(32):
        assert [bool(table[failed] >> s & 1) for s in range(32)] == [failed & s == 0 for s in range(32)]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert A.audit(docs([]), none).count() == 0
    got = A.audit(docs([(1, None, None)]), none).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and {r.good_lost for r in got} == {0}


def test_clashing_columns(spark, docs):
    df = docs(odd_texts())
    for name in ("part", "failed", "sha", "first", "good", "toxic", "of", "own", "bits"):
        df = df.withColumn(name, df.doc_id * 2)
    labels = spark.createDataFrame([(1, 1, 1, "x")], LABELS).selectExpr("*", "1 AS good", "2 AS of", "3 AS failed")
    assert A.audit(df, labels).count() == 600 * len({r[2] for r in odd_texts()})
