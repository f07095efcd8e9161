import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftwork.llm import language_id as L

from .conftest import odd_texts

SYLLABLES = {"en": ["th", "he", "in", "ou", "sh", "wh"], "de": ["sch", "ung", "ü", "ei", "tz"], "fr": ["eau", "é", "è", "qu"]}


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        word = lambda: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
        out.append((i, " ".join(word() for _ in range(rng.randint(3, 60))), lang, "s"))
    return out


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    w = L.fresh(3)
    x = rng.integers(0, 256, (6, 5)).astype(np.uint8)
    mask = np.ones((6, 5), np.float32)
    mask[4:, 2] = 0
    y = np.array([0, 1, 2, 1, 0])
    _, grads = L.loss_and_gradients(x, mask, y, w)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = w[name][at], 1e-2
        w[name][at] = kept + step
        up = L.loss_and_gradients(x, mask, y, w)[0]
        w[name][at] = kept - step
        down = L.loss_and_gradients(x, mask, y, w)[0]
        w[name][at] = kept
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-4, name


def test_every_position_counts():
    w = L.fresh(2)
    text = "abc é" * 100
    data = np.frombuffer(text.encode(), np.uint8)
    total = np.zeros(2)
    for low in range(0, len(data), L.WINDOW):
        x = np.zeros((L.WINDOW, 1), np.uint8)
        part = data[low:low + L.WINDOW]
        x[:len(part), 0] = part
        p = L.probabilities(np.concatenate([L.run_direction(x, w, d) for d in "fb"], -1), w)
        total += p[:len(part), 0].sum(0)
    got = L.pooled(pa.array(["", text, None, "x"]).fill_null(""), w)
    assert np.allclose(got[1], total / len(data), atol=1e-5) and got[0].sum() == 0 and np.isclose(got[3].sum(), 1, atol=1e-5)


def test_held_out_accuracy(docs):
    rows = texts(400, 1)
    got = L.identify(docs(rows)).collect()
    lang = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_ignore_lang_source_and_id(docs):
    rows = texts(200, 2)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    held = [r for r in rows if r not in learned]
    one = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in L.identify(docs(rows)).collect() if r.held_out}
    two = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in L.identify(
        docs(learned + [(i, t, "xx", None) for i, t, _, _ in held])).collect() if r.held_out}
    assert one == two


def test_odd_texts(docs):
    df = docs(odd_texts() + texts(60, 3))
    got = L.identify(df).collect()
    assert len(got) == len(odd_texts()) + 60
    by = {r.doc_id: r for r in got}
    # ids 1 to 3 occur in both lists
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id == 14 and r.lang_pred == "und")
    assert by[9].lang_pred != "und"
    kept = L.keep_identified(df)
    assert kept.columns == df.columns
    left = {(r.doc_id, r.text) for r in kept.collect()}
    assert all(t is not None and any(c.isalpha() for c in t) for _, t in left)
    assert {(r[0], r[1]) for r in texts(60, 3)} <= left


def test_nothing_to_learn(docs):
    assert L.identify(docs([])).count() == 0
    got = L.identify(docs([(1, "text", None, "a")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    one = L.identify(docs([(i, "text one", "en", "a") for i in range(9)])).collect()
    assert {r.lang_pred for r in one} == {"en"}


def test_every_label_is_learned(docs, monkeypatch):
    """Also those beyond the 64 most frequent, and a label of one text."""
    monkeypatch.setattr(L, "EPOCH_STEPS", 4)
    rows = [(i, f"{chr(0x4E00 + i % 70)} word {i}", f"l{i % 70:02}", "s") for i in range(280)] + [(999, "only one", "rare", "s")]
    classes, weights = L.fit(docs(rows), F.lit(True))
    assert classes == [f"l{k:02}" for k in range(70)] + ["rare"] and len(weights["c"]) == 71
