import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftwork.llm import packing as P
from siftwork.llm import tokens as T

from .conftest import odd_texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.vocabulary_path())


def strange_texts(n=150):
    rng = random.Random(5)
    signs = ["a", "the", " ", "  ", "\n", "\t", "'s", "'S", "'", "é", "東", "١", "Ⅷ", " ", "　", "\x1c", "\x85", "!!", "<|endoftext|>",
             "<|end", "1", "22", "aaaa", "\U0001f600", "́", "_", "-", "don't", "ſ", "​", "﻿"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_counts_equal_the_library(docs, library):
    rows = [(i, t) for i, t in enumerate(strange_texts())] + [(1000 + i, r[1]) for i, r in enumerate(odd_texts())]
    want = {i: len(e.ids) for (i, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows],
                                                                            add_special_tokens=False))}
    got = T.token_counts(docs(rows), limit=20).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(rows)
    size = {i: len((t or "").encode()) for i, t in rows}
    assert all(r.n_bytes == size[r.doc_id] and r.over_limit == (r.n_tokens > 20) for r in got)


def test_merges_give_the_library_s_symbols(library):
    merges = T.Merges(T.vocabulary_path())
    pieces = [" the", "aaaaaaa", " " * 50, "x" * 3000, "é東京", "'s", "\x00\xff"] + [f" word{i}" for i in range(500)]
    flat, own = merges.survivors([p.encode() for p in pieces])
    for i, p in enumerate(pieces):
        assert flat[own == i].tolist() == library.encode(p, add_special_tokens=False).ids
    assert merges.counts([]).tolist() == []


def test_overlapping_pairs():
    marks = np.array([1, 1, 1, 0, 1, 1, 0, 1], bool)
    assert T.leftmost(marks).tolist() == [True, False, True, False, True, False, False, True]


def test_empty_table(docs):
    assert T.token_counts(docs([])).count() == 0 and P.pack(docs([])).count() == 0


@pytest.mark.parametrize("capacity,per_task", [(1024, 50_000), (16, 7)])
def test_packing_round_trip(docs, library, capacity, per_task):
    rows = [(i, t) for i, t in enumerate(strange_texts(120))] + [(1000 + i, r[1]) for i, r in enumerate(odd_texts())]
    ids = {i: np.array([*e.ids, 2], "<u4") for (i, _), e in zip(rows, library.encode_batch(
        [t or "" for _, t in rows], add_special_tokens=False))}
    got = P.pack(docs(rows), capacity=capacity, per_task=per_task).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[i][at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= 1.2 * total / capacity + 2


def test_best_fit_is_best_fit():
    bins = P.best_fit(np.array([6, 5, 4, 4, 1]), 10)
    assert sorted(sorted(b) for b in bins) == [[0, 2], [1, 3, 4]]


def test_long_pre_tokens(library):
    rng = random.Random(9)
    merges = T.Merges(T.vocabulary_path())
    pieces = ["x" * 20_000, "ab" * 5_000, "aaab" * 700, "東京" * 400, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzE", k=100_000)),
              " " + "the" * 900, "q" * T.LONG, "q" * (T.LONG + 1), "short"]
    assert merges.counts([p.encode() for p in pieces]).tolist() == [
        len(library.encode(p, add_special_tokens=False).ids) for p in pieces]


def test_a_megabyte_without_a_gap(docs, library):
    text = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert T.token_counts(docs([(1, text)])).first().n_tokens == want


def test_encoder_equals_the_library(library):
    texts = [*strange_texts(400), " " * 1_000_000, "", "<|endoftext|><|endoftext|>"]
    got = P.Encoder(T.vocabulary_path())(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_code_points_are_cut_alike(library):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}.  {chr(c)} x" for c in range(0x110000)
             if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 37 == 0)]
    got = P.Encoder(T.vocabulary_path())(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_proof_of_the_fast_encoder(tmp_path):
    import json

    path = T.vocabulary_path()
    merges, tokens = T.Merges(path), P.token_bytes(path)
    assert P.by_bytes(merges, tokens) and P.Encoder(path).fast is not None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # two merges change places, so a later id is merged first
    listed = spec["model"]["merges"]
    listed[300], listed[40_000] = listed[40_000], listed[300]
    (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
    other = str(tmp_path / "v.json")
    assert not P.by_bytes(T.Merges(other), P.token_bytes(other))
    encoder = P.Encoder(other)
    assert encoder.fast is None
    texts = strange_texts(60)
    slow = Tokenizer.from_file(other)
    assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in slow.encode_batch(texts, add_special_tokens=False)]


def test_repeated_and_missing_ids(docs):
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (None, "four"), (None, None), (2, "")]
    counted = T.token_counts(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in counted) == [(0, 0), (0, 4), (1, 5), (1, 7), (1, 7), (2, 0)]
    packed = P.pack(docs(rows)).collect()
    assert len(packed) == 6 and sum(r.doc_id is None for r in packed) == 2
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))
