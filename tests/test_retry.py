"""Kept attempts against a generator that runs its batches one after the other."""

import random

import pytest

from siftwork.operators import chat as C
from siftwork.operators.retry import kept_attempts


def sequential(rows):
    taken, out = set(), set()
    tries = {}
    for b, a, k in rows:
        tries.setdefault(b, {}).setdefault(a, set()).add(k)
    for b in sorted(tries):
        for a in sorted(tries[b]):
            if tries[b][a] - taken:
                taken |= tries[b][a]
                out.add((b, a))
                break
    return out


@pytest.mark.parametrize("seed, last", [(1, 0), (3, 15), (4, 100_000)])
def test_random_attempts(spark, seed, last):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), rng.randrange(1, 5), f"k{min(rng.randrange(60), rng.randrange(60))}") for _ in range(150)]
    got = kept_attempts(spark.createDataFrame(rows, "batch_id long, attempt int, pair_hash string"), last=last)
    assert {tuple(r) for r in got.collect()} == sequential(rows)


def test_chain_and_hot_key(spark):
    # each batch waits for the one before it, and one key is in every first attempt
    rows = [r for b in range(6) for r in ((b, 1, "hot"), (b, 2, f"c{b // 2}"), (b, 3, f"c{(b + 1) // 2}"))]
    frame = spark.createDataFrame(rows, "batch_id long, attempt int, pair_hash string")
    assert {tuple(r) for r in kept_attempts(frame, last=0).collect()} == sequential(rows)
    assert {tuple(r) for r in kept_attempts(frame, last=4).collect()} == sequential(rows)


def test_nothing_and_nulls(spark):
    schema = "batch_id long, attempt int, pair_hash string"
    assert kept_attempts(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 1, None), (None, 1, "a"), (1, 2, "a"), (2, 1, "a")]
    assert [tuple(r) for r in kept_attempts(spark.createDataFrame(rows, schema), last=0).collect()] == [(1, 2)]


def test_unique_pairs_skips_attempts_of_earlier_batches(spark):
    rows = [(0, 1, 0, 0, "first question", "first answer"), (1, 1, 0, 1, "first question", "first answer"),
            (1, 2, 0, 1, "second question", "second answer"), (2, 1, 0, 2, "stored question", "stored answer"),
            (2, 2, 0, 2, "second question", "second answer"), (2, 3, 0, 2, "first question", "first answer")]
    pairs = spark.createDataFrame(rows, "batch_id long, attempt int, pos int, prompt_id long, user string, assistant string")
    flat = spark.createDataFrame([(0, "user", "stored question"), (1, "assistant", "stored answer")],
                                 "idx long, role string, content string")
    got = C.unique_pairs(pairs, C.existing_hashes(flat))
    assert sorted((r.batch_id, r.attempt) for r in got.collect()) == [(0, 1), (1, 2)]
    assert C.unique_pairs(pairs, C.existing_hashes(flat), max_attempts=1).count() == 1
