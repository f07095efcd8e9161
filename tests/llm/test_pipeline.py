"""The pipeline's stages against brute force on a small table."""

import random
import re

import pytest

import corpus_pipeline
from siftwork.llm import language_id, mixing

from .conftest import odd_texts
from .test_exact_dedup import lower
from .test_ngram_join import brute, near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, t, "en", f"s{i % 4}" if i % 3 else None) for i, t in near_copies(3, groups=6, others=30)]
    rows += [(1000 + k, r[1].upper(), *r[2:]) for k, r in enumerate(rows[::9])]
    rows += [((r[0] or 0) + 2000 if r[0] else None, *r[1:]) for r in odd_texts()]
    rng.shuffle(rows)
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS).repartition(3).write.parquet(
        f"{path}/documents.parquet")
    return str(path)


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_duplicates", "source_mix", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "language_id":
            keeps = lambda t: t is not None and any(c.isalpha() for c in t)
            assert {r.text for r in after} <= {r.text for r in before if keeps(r.text)}
            clean = {r.doc_id for r in before if keeps(r.text) and r.doc_id is not None and r.doc_id < 2000}
            assert clean <= {r.doc_id for r in after}
        elif name == "exact_dedup":
            groups = {}
            for r in before:
                groups.setdefault(lower(r.text), []).append(-1 if r.doc_id is None else r.doc_id)
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in after) == sorted(max(g) for g in groups.values())
        elif name == "near_duplicates":
            component = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in before])}
            stay = [r for r in before if r.doc_id is None or component[r.doc_id] == r.doc_id]
            assert sorted(map(str, after)) == sorted(map(str, stay)) and len(after) < len(before)
        elif name == "source_mix":
            copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(spark.read.parquet(f"{tmp_path}/near_duplicates")).collect()}
            got = {}
            for r in after:
                got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
            assert got == {k: n for k, n in copies.items() if n}
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            assert sum(size(r.text) for r in after) > 0
        else:
            lengths = {}
            for r in after:
                lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
            assert max(lengths.values()) <= 1024
            firsts = {}
            for r in after:
                firsts[r.doc_id] = firsts.get(r.doc_id, 0) + (r.piece == 0)
            want = {}
            for r in before:
                want[r.doc_id] = want.get(r.doc_id, 0) + 1
            assert firsts == want


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unknown_languages_go(spark):
    rows = [(i, "some words of a text " * 3, "en", "s", 0) for i in range(8)] + [(90, "123 456", "en", "s", 0)]
    out = corpus_pipeline.known_language(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert {r.doc_id for r in out.collect()} == set(range(8))
    assert 1 <= language_id.LEAST < 1.2  # of chance
