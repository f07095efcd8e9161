"""Language ID by a bidirectional gated recurrent network over bytes.

The UTF-8 bytes of a whole text are read in windows of ``WINDOW``; in each a GRU
runs forward and another backward, and a softmax over both states labels every
position.  A document's probabilities are the means over all its positions.  The
network is trained here, in numpy, by backpropagation through time with Adam, on
windows at random places of at most ``DOCS`` labelled texts of each language (a
bounded sample of every label; everything is fixed by the seed).  Inference is array work over thousands of windows at once inside Spark tasks.

Defined cases: a null text, or one without any letter, is ``und`` with score 0, as
are all texts if nothing is labelled; ties go to the language first in order;
rows are judged one by one, so repeated rows and ids are no matter.  Other columns, whatever
their names, are ignored (``keep_identified`` carries them); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import held_out, worker_cache

UNKNOWN = "und"
WINDOW, HIDDEN = 64, 8
DOCS, SNIPPETS = 300, 4
EPOCH_STEPS, BATCH, RATE = 260, 128, 0.02
#: Languages that the steps are for; more take more steps, and fewer windows run together.
LANGUAGES = 64
#: Windows run together: their states fit a core's cache.
TOGETHER = 8192
SEED = 11
#: A document whose score is less than this many times 1 / languages goes.  As a score is
#: never below 1 / languages, hardly any does: texts in a language not learned stay.
LEAST = 1.05

Weights = dict[str, np.ndarray]
ALL_BYTES = np.arange(256, dtype=np.uint8)[:, None]


def squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh(classes: int) -> Weights:
    rng = np.random.default_rng(SEED)
    h = HIDDEN
    out = {"v": rng.normal(0, 0.3, (2 * h, classes)), "c": np.zeros(classes)}
    for d in "fb":
        out |= {"e" + d: rng.normal(0, 0.3, (256, 3 * h)), "u" + d: rng.normal(0, 0.3, (h, 3 * h)),
                "k" + d: np.zeros(3 * h)}
    return {k: w.astype(np.float32) for k, w in out.items()}


def run_direction(x: np.ndarray, w: Weights, d: str, keep: list | None = None) -> np.ndarray:
    """States (T, N, H) of one direction for bytes (T, N); ``keep`` gets what backpropagation needs."""
    h = HIDDEN
    e, u, k = w["e" + d], w["u" + d], w["k" + d]
    states = np.empty((*x.shape, h), np.float32)
    state = np.zeros((x.shape[1], h), np.float32)
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        a, g = e[x[t]], state @ u
        g += k
        gates = squash(a[:, :2 * h] + g[:, :2 * h])
        z, r = gates[:, :h], gates[:, h:]
        n = np.tanh(a[:, 2 * h:] + r * g[:, 2 * h:])
        if keep is not None:
            keep.append((t, state, z, r, n, g[:, 2 * h:]))
        state = n + z * (state - n)
        states[t] = state
    return states


def back_direction(x: np.ndarray, w: Weights, d: str, kept: list, grad: np.ndarray) -> Weights:
    """Gradients of one direction from those of its states (T, N, H)."""
    h = HIDDEN
    u = w["u" + d]
    de, du, dk = np.zeros_like(w["e" + d]), np.zeros_like(u), np.zeros_like(w["k" + d])
    later = np.zeros(grad.shape[1:], np.float32)
    for t, before, z, r, n, gn in reversed(kept):
        dh = grad[t] + later
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        da = np.concatenate((dz, dr, dn), 1)
        dg = np.concatenate((dz, dr, dn * r), 1)
        de += (x[t][None, :] == ALL_BYTES).astype(np.float32) @ da
        du += before.T @ dg
        dk += dg.sum(0)
        later = dh * z + dg @ u.T
    return {"e" + d: de, "u" + d: du, "k" + d: dk}


def probabilities(states: np.ndarray, w: Weights) -> np.ndarray:
    logits = states @ w["v"] + w["c"]
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    return logits / logits.sum(-1, keepdims=True)


def loss_and_gradients(x: np.ndarray, mask: np.ndarray, y: np.ndarray, w: Weights) -> tuple[float, Weights]:
    """Mean cross entropy over the valid positions of bytes (T, N) with labels (N,)."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([run_direction(x, w, d, kept[d]) for d in "fb"], -1)
    p = probabilities(states, w)
    total = mask.sum()
    right = p[:, np.arange(len(y)), y]
    loss = float(-(np.log(right + 1e-9) * mask).sum() / total)
    p[:, np.arange(len(y)), y] -= 1
    p *= mask[..., None] / total
    grads = {"v": np.einsum("tnh,tnk->hk", states, p), "c": p.sum((0, 1))}
    flow = p @ w["v"].T
    grads |= back_direction(x, w, "f", kept["f"], flow[..., :HIDDEN])
    grads |= back_direction(x, w, "b", kept["b"], flow[..., HIDDEN:])
    return loss, grads


def train(snippets: list[bytes], labels: np.ndarray, classes: int) -> Weights:
    """Adam over random batches of windows."""
    w = fresh(classes)
    x = np.zeros((WINDOW, len(snippets)), np.uint8)
    mask = np.zeros((WINDOW, len(snippets)), np.float32)
    for i, s in enumerate(snippets):
        part = np.frombuffer(s[:WINDOW], np.uint8)
        x[:len(part), i], mask[:len(part), i] = part, 1
    rng = np.random.default_rng(SEED)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    steps = EPOCH_STEPS * max(1, -(-classes // LANGUAGES))
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(snippets), BATCH)
        _, grads = loss_and_gradients(x[:, chosen], mask[:, chosen], labels[chosen], w)
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (first[k] / (1 - 0.9 ** step))
                    / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return w


def read_direction(x: np.ndarray, w: Weights, d: str) -> np.ndarray:
    """The states of ``run_direction`` for reading only: the same steps in place, with
    gates as tanh of half their sum and the constants folded into the tables."""
    h = HIDDEN
    e, u, k = w["e" + d], w["u" + d], w["k" + d]
    gate_table, gate_u = 0.5 * (e[:, :2 * h] + k[:2 * h]), np.ascontiguousarray(0.5 * u[:, :2 * h])
    new_table, new_u, new_k = np.ascontiguousarray(e[:, 2 * h:]), np.ascontiguousarray(0.5 * u[:, 2 * h:]), 0.5 * k[2 * h:]
    n = x.shape[1]
    states = np.empty((len(x), n, h), np.float32)
    state = np.zeros((n, h), np.float32)
    gates, part = np.empty((n, 2 * h), np.float32), np.empty((n, 2 * h), np.float32)
    new, half = np.empty((n, h), np.float32), np.empty((n, h), np.float32)
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        np.take(gate_table, x[t], axis=0, out=gates, mode="clip")
        gates += np.dot(state, gate_u, out=part)
        np.tanh(gates, out=gates)
        np.take(new_table, x[t], axis=0, out=new, mode="clip")
        np.dot(state, new_u, out=half)
        half += new_k
        new += half
        half *= gates[:, h:]
        new += half
        np.tanh(new, out=new)
        np.subtract(state, new, out=half)
        half *= 0.5
        new += half
        half *= gates[:, :h]
        state = np.add(new, half, out=states[t])
    return states


def window_sums(x: np.ndarray, mask: np.ndarray, w: Weights) -> np.ndarray:
    """Sums over the valid positions of the probabilities at each (classes, N)."""
    length, n = x.shape
    logits = sum(read_direction(x, w, d).reshape(-1, HIDDEN) @ part
                 for d, part in (("f", w["v"][:HIDDEN]), ("b", w["v"][HIDDEN:])))
    # states are within -1 and 1, which bounds the logits
    p = np.ascontiguousarray((logits + (w["c"] - np.abs(w["v"]).sum(0).max())).T)
    np.exp(p, out=p)
    p *= (mask.reshape(-1) / p.sum(0))
    return p.reshape(len(p), length, n).sum(1)


def pooled(texts: pa.Array, w: Weights) -> np.ndarray:
    """Mean probabilities (texts, classes) over all byte positions; zeros for empty texts."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][owner] + nth * WINDOW
    sizes = np.minimum(lengths[owner] - nth * WINDOW, WINDOW)
    total = np.zeros((len(texts), len(w["c"])))
    together = max(1, TOGETHER // max(1, -(-len(w["c"]) // LANGUAGES)))
    for low in range(0, len(owner), together):
        part = slice(low, low + together)
        place = np.arange(WINDOW)[:, None]
        mask = place < sizes[part]
        x = np.where(mask, data[np.minimum(starts[part] + place, len(data) - 1)], 0)
        for k, sums in enumerate(window_sums(x, mask.astype(np.float32), w)):
            total[:, k] += np.bincount(owner[part], sums, len(texts))
    return total / np.maximum(lengths, 1)[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def labelled_snippets(docs: DataFrame, doc_id: str, text: str, lang: str, learn: Column) -> tuple[list, list]:
    """Pieces at hashed places of a bounded number of texts of every language.  Of a language
    with many texts only those of low hash are ranked, four times as many as are used,
    and only their pieces move."""
    usable = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"),
                         learn.alias("learn")).filter(F.col("lang").isNotNull() & F.col("learn") & has_letter(F.col("text")))
    often = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("name"), "n")
    length = F.char_length("text")
    mark = F.xxhash64("id", length)
    places = F.array(*[F.pmod(F.xxhash64(mark, F.lit(i)), F.greatest(length - WINDOW // 2, F.lit(1)))
                       for i in range(SNIPPETS)])
    pieces = F.transform(places, lambda at: F.substring(F.col("text"), at.cast("int") + 1, F.lit(WINDOW)))
    low = (usable.join(F.broadcast(often), F.col("lang") == F.col("name"))
           .filter(F.pmod(mark, F.lit(1 << 30)) / float(1 << 30) < F.lit(4.0 * DOCS) / F.col("n"))
           .select("name", mark.alias("mark"), pieces.alias("pieces")))
    order = Window.partitionBy("name").orderBy("mark", F.hash("pieces"))
    rows = (low.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= DOCS)
            .select("name", "k", F.posexplode("pieces").alias("i", "s")).collect())
    rows.sort(key=lambda r: (r["name"], r["k"], r["i"]))
    return [r["s"].encode() for r in rows], [r["name"] for r in rows]


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"):
    """Languages and weights, learned from the rows where ``learn`` holds."""
    snippets, names = labelled_snippets(docs, doc_id, text, lang, learn)
    classes = sorted(set(names))
    if not classes:
        return classes, None
    return classes, train(snippets, np.array([classes.index(n) for n in names]), len(classes))


def predicted(texts: pa.Array, model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    worker_cache("language")
    classes, weights = model
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    lettered = np.asarray(pa.compute.match_substring_regex(texts, r"\pL")) if len(texts) else np.zeros(0, bool)
    if weights is None or not lettered.any():
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    # a text without a letter needs no network
    p = pooled(pa.compute.if_else(pa.array(lettered), texts, ""), weights)
    names = [classes[b] if j else UNKNOWN for b, j in zip(p.argmax(1).tolist(), lettered.tolist())]
    return names, np.where(lettered, np.minimum(p.max(1), 1.0), 0.0)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows not held out."""
    out_of = held_out(doc_id, modulus, remainder)
    told = docs.sparkSession.sparkContext.broadcast(fit(docs, ~out_of, doc_id, text, lang))
    source = docs.select(F.col(doc_id).alias("doc_id"), out_of.alias("held_out"), F.col(text).alias("text"))
    schema = StructType([source.schema["doc_id"], StructField("held_out", BooleanType()),
                         StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predicted(batch.column("text"), told.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"),
                                              pa.array(names, pa.string()), pa.array(scores)], schema.names)

    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text",
                    lang: str = "lang", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """The rows of ``docs`` with a known language and a score of at least ``least`` times
    chance, all columns."""
    model = fit(docs, ~held_out(doc_id, modulus, remainder), doc_id, text, lang)
    told = docs.sparkSession.sparkContext.broadcast(model)
    floor = least / len(model[0]) if len(model[0]) > 1 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predicted(batch.column(text), told.value)
            yield batch.filter(pa.array([n != UNKNOWN and s >= floor for n, s in zip(names, scores.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
