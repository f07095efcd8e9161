import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftwork.llm import pitman_yor as P

from .conftest import odd_texts


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    follows = {w: rng.sample(words, 6) for w in words}
    rows = []
    for i in range(n):
        at, out = rng.choice(words[:40]), []
        for _ in range(rng.randint(0, 80)):
            out.append(at.upper() if rng.random() < 0.1 else at)
            at = rng.choice(follows.get(at, words)) if rng.random() < 0.8 else (rng.choice(words) if rng.random() < .9 else f"new{i}")
        rows.append((i, " ".join(out)))
    return rows


def check(df, **params):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    count = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    total, kinds = sum(count.values()), len(count)
    want = Counter()
    for i, x in rows:
        ts = tokens(x)
        base = sum(math.log10((count[t] + 1) / (total + kinds + 1)) for t in ts)
        want[i, held(i), len(ts), sum(count[t] > 0 for t in ts), total, round(base, 4)] += 1
    got = P.lm_scores(df, **params).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
                   for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    return got


def test_counts_base_and_gain(docs):
    got = check(docs(corpus(300)), contexts=500, shards=5)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)


def test_places_of_scoring_agree(docs):
    """Scores do not depend on which dishes are told to all tasks."""
    df = docs(corpus(120))
    one = sorted((r.doc_id, round(r.score, 6)) for r in P.lm_scores(df, contexts=300, told_share=1, shards=3).collect())
    two = sorted((r.doc_id, round(r.score, 6)) for r in P.lm_scores(df, contexts=300, told_share=1 << 20, shards=3).collect())
    assert one == two


def test_odd_texts(docs):
    check(docs(odd_texts()), contexts=50)


def test_many_batches(docs, monkeypatch):
    monkeypatch.setattr(P, "BATCH", 400)
    check(docs(corpus(150, 4)), contexts=200, shards=4)


def test_no_training_text(docs):
    assert P.lm_scores(docs([])).count() == 0
    only = next(i for i in range(100) if held(i))
    got = P.lm_scores(docs([(only, "a b")])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)]


def model_of(pairs, frequent):
    """One shard with these (word, context place) counts, and what is shared of it."""
    keys = sorted(pairs)
    words = np.array([k[0] for k in keys], np.uint64)
    distinct, times = np.unique(words, return_counts=True)
    n = np.array([pairs[k] for k in keys])
    payload = b"".join((np.array([len(distinct), len(keys)], "<i8").tobytes(), distinct.astype("<u8").tobytes(),
                        times.astype("<u4").tobytes(), np.array([k[1] for k in keys], "<u2").tobytes(), n.astype("<u4").tobytes()))
    shared = P.Shared(frequent, int(n.sum()))
    shared.words = len(distinct)
    shared.customers = np.bincount([k[1] for k in keys], n, len(frequent) + 1).astype(float)
    return payload, shared


def test_probabilities_sum_to_one_and_seating_is_kept():
    rng = random.Random(2)
    frequent = np.array([900, 901, 902], np.uint64)  # contexts only: their own words are elsewhere
    pairs = {(w, c): rng.randint(1, 9) ** rng.randint(1, 3) for w in range(10, 60) for c in range(4) if rng.random() < 0.5}
    payload, shared = model_of(pairs, frequent)
    for k in range(P.SWEEPS + 1):
        dishes = P.Dishes(payload, shared)
        for s in range(k):
            dishes.sweep(s, 0)
            assert (dishes.sizes > 0).all()
            assert (np.bincount(dishes.owners, dishes.sizes) == dishes.counts[dishes.many]).all()
        assert (dishes.tables[dishes.own] >= 1).all() and (dishes.tables <= dishes.counts).all()
        shared.tables.append(np.bincount(dishes.contexts, dishes.tables, 4))
        shared.root.append(np.zeros(4))
        shared.root_customers.append(float(dishes.root_customers().sum()))
    assert dishes.tables.sum() > len(dishes.tables)  # some dishes have several tables
    dishes = P.Dishes(payload, shared)
    p, roots = dishes.predictive(0)
    states = range(2, P.SWEEPS + 1)
    for context in range(4):
        here = dishes.contexts == context
        backs = np.array([shared.back_off(k)[context] for k in states])
        seen = np.isin(np.arange(shared.words), dishes.word_at[here])
        total = (p[here].sum() if context else 0) + (backs[:, None] * roots)[:, ~seen if context else slice(None)].mean(0).sum()
        total += np.mean([b * shared.root_p(np.zeros(1), k)[0] for b, k in zip(backs, states)])
        assert abs(total - 1) < 1e-9


def test_fixed_by_the_seed(docs):
    df = docs(corpus(60))
    one, two = [sorted((r.doc_id, r.score) for r in P.lm_scores(df, contexts=100, shards=2).collect()) for _ in range(2)]
    assert [a for a, _ in one] == [a for a, _ in two] and np.allclose([s for _, s in one], [s for _, s in two])


def full_sampler(pairs, kinds, d, sweeps, skipped, seed=1):
    """Mean tables of each dish when every customer leaves and sits down again, one by one."""
    rng = random.Random(seed)
    seats = {k: [n] for k, n in pairs.items()}
    inside, root = Counter(c for _, c in pairs), Counter(w for w, _ in pairs)
    free, mean = (P.THETA + d * kinds) / (kinds + 1), Counter()
    for s in range(sweeps):
        for (w, c), sizes in seats.items():
            for _ in range(pairs[w, c] if pairs[w, c] > 1 else 0):
                leaves = rng.choices(range(len(sizes)), sizes)[0]
                sizes[leaves] -= 1
                if not sizes[leaves]:
                    del sizes[leaves]
                    inside[c] -= 1
                    root[w] -= 1
                p_root = (max(root[w] - d, 0) + free) / (P.THETA + sum(root.values()))
                at = rng.choices(range(len(sizes) + 1), [n - d for n in sizes] + [(P.THETA + d * inside[c]) * p_root])[0]
                if at == len(sizes):
                    sizes.append(0)
                    inside[c] += 1
                    root[w] += 1
                sizes[at] += 1
        if s >= skipped:
            mean.update({k: len(sizes) / (sweeps - skipped) for k, sizes in seats.items()})
    return mean


def swept(pairs, sweeps):
    """Tables of each dish, in the order of the keys, after each sweep."""
    payload, shared = model_of(pairs, np.array([900, 901, 902], np.uint64))
    dishes, out = P.Dishes(payload, shared), []
    for k in range(sweeps):
        shared.tables.append(np.bincount(dishes.contexts, dishes.tables, 4))
        shared.root.append(np.zeros(4))
        shared.root_customers.append(float(dishes.root_customers().sum()))
        dishes.sweep(k, 0)
        out.append(dishes.tables)
    return np.array(out)


def test_tables_are_those_of_a_full_sampler():
    rng = random.Random(2)
    pairs = {(w, c): rng.choice([1, 1, 2, 3, 5, 8, 20, 60, 100]) for c in (1, 2, 3) for w in range(10, 50) if rng.random() < 0.6}
    pairs = {k: pairs[k] for k in sorted(pairs)}
    mean = full_sampler(pairs, len({w for w, _ in pairs}), 0.75, 400, 50)
    want = np.array([mean[k] for k in pairs])
    got = swept(pairs, 400)
    assert abs(got[1:P.SWEEPS].sum(1).mean() / want.sum() - 1) < 0.2  # the states that are averaged
    assert abs(got[50:].sum(1).mean() / want.sum() - 1) < 0.1
    assert np.corrcoef(got[50:].mean(0), want)[0, 1] > 0.95


def test_large_dishes_get_their_tables():
    """The moments of large dishes are those of the exact weights, and 100,000 customers are no obstacle."""
    many = [np.full(2000, x) for x in (600, 300.0, 40.0, 9000.0)]
    large = P.drawn_tables(np.random.default_rng(1), many[0], 0.75, *many[1:])
    ways = [0.0]
    for n in range(1, 600):
        joins = np.log(n - 0.75 * np.arange(1, n + 1)) + ways
        ways = np.logaddexp(np.append(joins, -np.inf), np.append(-np.inf, ways))
    j = np.arange(1, 600)
    weights = ways + np.append(0, np.cumsum(np.log((300 + 0.75 * j) * (40 + j) / (9000 + j))))
    exact = np.exp(weights - weights.max())
    exact /= exact.sum()
    mean = (exact * np.arange(1, 601)).sum()
    sd = ((exact * (np.arange(1, 601) - mean) ** 2).sum()) ** 0.5
    assert abs(large.mean() - mean) < 0.15 * sd and abs(large.std() / sd - 1) < 0.15
    pairs = {(w, c): 100_000 for w in range(10, 30) for c in (1, 2, 3)} | {(w, c): 1 for w in range(30, 300) for c in (1, 2, 3)}
    assert swept(pairs, P.SWEEPS)[-1].max() > 13


def test_frequent_words_do_not_depend_on_partitions(spark, monkeypatch):
    """21 of 200 tokens are a tenth, though one task has only two of them; single counts add up too."""
    texts = [" ".join(["often"] * n + [f"w{n}x{k}" for k in range(99 - n)]) for n in (19, 2)]
    rows = spark.sparkContext.parallelize([(i, x, False) for i, x in enumerate(texts)], 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    with_told = P.frequent_words(df, 10)
    monkeypatch.setattr(P, "MOST_WORDS", 10, raising=False)
    monkeypatch.setattr(P, "BATCH", 50)
    in_pieces = P.frequent_words(df, 10)
    often = P.word_hashes(pa.array(["often"]))
    often = next(iter(often))[2][0]
    for words, total in (with_told, in_pieces):
        assert total == 200 and set(words.tolist()) == {int(P.START), int(often)}


def test_every_context_has_a_restaurant(docs):
    """No word is frequent here, and every dish has one customer, so one table: scores by hand."""
    rows = [(i, f"s{i} x{i % 7} y{i} z{i % 5} e{i}") for i in range(60) if not held(i)]
    rows += [(i, "x1 z3 e2 x2 y9 new y9 E4 s1") for i in range(60) if held(i)]
    learned = [tokens(x) for i, x in rows if not held(i)]
    pairs = [p for ts in learned for p in zip(["start", *ts], ts)]
    assert len(set(pairs)) == len(pairs)
    inside, root = Counter(u for u, _ in pairs), Counter(w for _, w in pairs)
    kinds, customers, d = len(root), len(pairs), 0.75
    n1, n2 = (sum(n == k for n in root.values()) for k in (1, 2))
    root_d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
    root_d = min(0.95, max(0.05, root_d))

    def p(u, w):
        of_root = ((root[w] - root_d if root[w] else 0) + (1 + root_d * kinds) / (kinds + 1)) / (1 + customers)
        return ((1 - d if (u, w) in set(pairs) else 0) + (1 + d * inside[u]) * of_root) / (1 + inside[u])

    want = {i: sum(math.log10(p(u, w)) for u, w in zip(["start", *tokens(x)], tokens(x))) for i, x in rows}
    got = {r.doc_id: r.score for r in P.lm_scores(docs(rows), contexts=1, shards=3).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_rare_and_frequent_contexts_score_alike(docs):
    """Which contexts are told to all decides where a dish is kept, not what it is worth."""
    df = docs(corpus(150, 5))
    one, two = ({r.doc_id: r.score for r in P.lm_scores(df, contexts=c, shards=3).collect()} for c in (1, 60_000))
    assert abs(sum(one.values()) / sum(two.values()) - 1) < 0.01
    assert np.corrcoef([one[i] for i in one], [two[i] for i in one])[0, 1] > 0.999


def test_every_shard_has_a_partition(spark):
    """Shards were dealt by the hash of their number, several to some tasks and none to others."""
    shards = 23
    homes = P.homes_of(spark, shards)
    assert len(set(homes)) == shards
    rows = spark.createDataFrame([(0, k, 0, b"") for k in [*range(shards), -2, -3]], P.PACKET)
    dealt = P.at_home(rows, homes).repartition(shards, "home").select("key", F.spark_partition_id().alias("at")).collect()
    assert sorted(r.at for r in dealt if r.key >= 0) == list(range(shards))
    assert sorted(r.key for r in dealt if r.key < 0) == [-3, -2]


def test_packets_are_packed_and_sent_a_few_at_a_time():
    payloads = [np.full(P.PIECE // 4, k, "<u2").tobytes() for k in range(8)] + [b""]
    batches = list(P.pieces((P.AFTER, k, 5, x) for k, x in enumerate(payloads)))
    assert len(batches) > 3 and max(b.nbytes for b in batches) < P.PIECE // 8
    found = [(r, P.unpacked(x).to_pybytes()) for b in batches for r, x in zip(b.column("key").to_pylist(), b.column("payload"))]
    assert found == list(enumerate(payloads))


def test_shards_follow_the_size_of_the_texts():
    """Every two shards may write to each other: a wide shuffle of a small table made hundreds of them."""
    assert [P.shards_for(w, 50_000_000) for w in (8, 51, 211)] == [8, 51, 64]
    assert P.shards_for(3000, 30_000_000_000) == 3000 and P.shards_for(8, 30_000_000_000) == 1500
    assert P.shards_for(8, 0) == 8
