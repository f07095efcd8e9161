import re

import pytest

from siftwork.llm import mixing as M

from .conftest import odd_texts


def target_by_hand(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop at most * size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, free = {}, set(names)
    while free:
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        for s in over:
            fixed[s] = most * sizes[s]
            free.discard(s)
    return fixed


def check(df, near):
    rows = df.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
    want = target_by_hand(sizes)
    got = M.mix(df).collect()
    assert sorted((r.source or "", r.size) for r in got) == sorted((r.source or "", count(r.text)) for r in rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    largest = max(r.size for r in got)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(near * t, largest)
    again = M.mix(df.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = M.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_odd_texts(docs):
    check(docs(odd_texts()), 0.2)


def test_hot_source_and_stops(docs):
    rows = [(i, "w " * (1 + i * 37 % 90), "en", "hot" if i % 3 else f"s{i % 11}") for i in range(900)]
    rows += [(5000 + i, "tiny", "en", "z") for i in range(3)]
    check(docs(rows), 0.02)


def test_all_empty(docs):
    got = M.mix(docs([(1, None, "en", "a"), (2, " ", "en", "b")])).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0), (0.0, 0)]
    assert M.mix(docs([])).count() == 0 and M.mixed_documents(docs([])).count() == 0
