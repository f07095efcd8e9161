import itertools
import random
import re

import numpy as np
import pyarrow as pa

from siftwork.llm import components as C
from siftwork.llm import ngram_join as J
from siftwork.llm import words as W

from .conftest import odd_texts


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (set sizes, component) over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        n = len(a & b)
        if 100 * n >= 75 * (len(a) + len(b) - n):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def check(df, monkeypatch=None, **params):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df, **params).collect()), key=str)
    assert got == brute(rows)
    return got


def near_copies(seed, groups=12, others=80):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 300))
    rows, n = [], 0
    passage = [word() for _ in range(30)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            rows.append((n, " ".join(text)))
            n += 1
    for _ in range(others):
        text = [word() for _ in range(rng.randint(3, 60))]
        at = rng.randint(0, len(text))
        rows.append((n, " ".join(text[:at] + passage + text[at:])))
        n += 1
    return rows


def test_odd_texts(docs):
    check(docs([r for r in odd_texts() if r[0] != 9]))


def test_near_copies_and_common_passages(docs):
    got = check(docs(near_copies(1)), blocks=3)
    assert len({c for _, _, c in got}) < len(got)


def test_frequent_columns_and_many_batches(docs, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT_FROM", 4)
    monkeypatch.setattr(J, "BATCH", 500)
    check(docs(near_copies(2)), blocks=5)


def test_chain_is_one_component(docs):
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words[k:k + 40])) for k in range(0, 20, 2)]
    got = check(docs(rows))
    assert len({c for _, _, c in got}) == 1


def test_exact_threshold(docs):
    # 7 and 7 shingles of which 6 are common: 6 / 8 = 75%; one less is below
    a = [f"a{i}" for i in range(11)]
    check(docs([(1, " ".join(a)), (2, " ".join([*a[1:], "z"])), (3, " ".join([*a[2:], "y", "x"]))]))


def test_one_large_group(docs):
    base = [f"w{i}" for i in range(80)]
    rng = random.Random(4)
    rows = []
    for n in range(150):
        text = list(base)
        text[rng.randrange(80)] = f"n{n}"
        rows.append((n, " ".join(text)))
    check(docs(rows + [(500 + i, " ".join(base)) for i in range(30)]))


def test_empty_table(docs):
    assert J.near_duplicates(docs([])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in {x for a, b in edges if a != b for x in (a, b)}}


def test_word_hashes():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB \t\n\x0b é") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " "]
    ids = {}
    for array in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        for first, end, found, counts in W.word_hashes(array):
            for i in range(first, end):
                words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or ""))
                hashes = found[counts[i - first]:counts[i - first + 1]].tolist()
                assert len(words) == len(hashes)
                for w, h in zip(words, hashes):
                    assert ids.setdefault(w, h) == h
    assert len(set(ids.values())) == len(ids)


def test_packed_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << J.KEY_BITS, 5000).astype(np.uint64))
    marks = (np.arange(len(keys)) % 60_000).astype(np.uint16)
    a, b = J.unpacked(J.packed(keys, marks))
    assert (a == keys).all() and (b == marks).all()


def words_of(mark, n=60):
    return [f"{mark}{i}" for i in range(n)]


def test_two_texts_under_one_id(docs):
    a, b, c = words_of("a"), words_of("b"), words_of("c")
    text = lambda w, k=None: " ".join(w if k is None else [*w[:k], "x", *w[k + 1:]])
    rows = [(1, text(a)), (1, text(b)), (2, text(a, 3)), (3, text(b, 50)), (4, text(c)), (5, text(c, 9)), (5, text(words_of("e"))),
            (6, text(words_of("e"), 2)), (7, text(words_of("f"))), (7, text(words_of("f")))]
    got = {(r.doc_id, r.component_id) for r in J.near_duplicates(docs(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)}


def test_no_text_goes_for_another_of_its_id(docs):
    a, b, c = words_of("a"), words_of("b"), words_of("c")
    near = " ".join([*a[:30], "x", *a[31:]])
    kept = J.keep_representatives(docs([(5, " ".join(a)), (5, " ".join(b)), (2, near), (4, " ".join(c)), (None, near)]))
    assert sorted((r.doc_id or 0, r.text[:2]) for r in kept.collect()) == [(0, "a0"), (2, "a0"), (4, "c0"), (5, "b0")]
    # both texts of one id are near copies of others: each component keeps the one of the smallest id
    kept = J.keep_representatives(docs([(1, " ".join(a)), (1, " ".join(b)), (2, near), (3, " ".join([*b[:9], "y", *b[10:]]))]))
    assert sorted((r.doc_id, r.text[:2]) for r in kept.collect()) == [(1, "a0"), (1, "b0")]
