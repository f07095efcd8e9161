import random
import re
from collections import Counter

import numpy as np

from siftwork.llm import quality_rules as Q

from .conftest import odd_texts

LABELS = "doc_id long, quality int, toxic int, text string"


def by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def check(df):
    got = Q.statistics(df.select("doc_id", "text")).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == Counter((r.doc_id, *by_hand(r.text)) for r in df.collect())


def test_statistics_of_odd_texts(docs):
    check(docs(odd_texts()))


def test_repeated_windows(docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc" if i % 3 else "abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(900, "a " * 3000), (901, "x\ny\nx\n\n \nx"), (902, "l1 #\nl1 #\r\nl1 #\n")]
    check(docs(rows))


def corpus(n):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 90))]
        bad = i % 5 == 0
        if bad:
            words = [w + "###" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 0 if bad else 1, 0, "clash"))
    return rows, labels


def test_learned_list_separates(spark, docs):
    rows, labels = corpus(600)
    df = docs(rows + [(r[0] + 10_000, r[1]) for r in odd_texts() if r[0]])
    labels += [(5, None, 0, None), (None, 0, 0, None), (77_777, 0, 0, None)]
    out = Q.quality_rules(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == df.count()
    quality = {i: q for i, q, _, _ in labels[:600]}
    wrong = [r.doc_id for r in out if r.doc_id in quality and r.kept != bool(quality[r.doc_id])]
    assert len(wrong) <= 6
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out)
    assert not any(r.kept and r.base_failed for r in out)


def test_emitted_list_equals_the_learned_one(spark, docs):
    rows, labels = corpus(300)
    values, bad = Q.labelled_statistics(docs(rows), spark.createDataFrame(labels, LABELS))
    rules = Q.learn(values, bad)
    assert rules and all(len(r) <= Q.MOST_CONDITIONS for r in rules)
    fired = np.zeros(len(bad), int)
    for k, rule in enumerate(rules, 1):
        fired[(fired == 0) & Q.holds(rule, values)] = k
    got = Counter(r.rule or 0 for r in Q.judged(docs(rows), rules).collect())
    assert got == Counter(fired.tolist())


def test_too_few_examples(spark, docs):
    none = spark.createDataFrame([], LABELS)
    out = Q.quality_rules(docs(odd_texts()), none).collect()
    assert len(out) == len(odd_texts()) and all(r.kept == (not r.base_failed) for r in out)
    assert Q.quality_rules(docs([]), none).count() == 0
