"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens by the vocabulary's pattern.  Pre-tokens not met
before by this worker are held together as ragged numpy arrays: one flat array of
symbols and one of owners.  In each round every sequence applies its own
lowest-rank pair at all places, left to right; a round is a few array operations
for all sequences at once.  When no pair has a rank, the surviving symbols are
counted.  A special string inside a text is one token, as the tokenizer's default
has it, and ends the pre-token before it.

Defined cases: null and empty text have 0 bytes and 0 tokens.  Texts are whole,
however long, and so are pre-tokens: one of more than ``LONG`` bytes is merged by the same
rule with a heap.  Rows are independent, so repeated rows, repeated ids and rows without an
id are no matter; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import worker_cache

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens kept per worker; the store starts anew beyond it.
KEPT = 600_000
#: Bytes of a pre-token beyond which it is merged on its own.
LONG = 512
NO_RANK = np.int64(1) << 40


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The vocabulary's pre-token pattern, white space as Unicode has it.  Words and numbers
    are tried first: they begin with a letter, a digit or a space, contractions with a quote."""
    import public_tokenizers

    found = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(
        r"\S", r"\P{White_Space}")
    first = r" ?\p{L}+| ?\p{N}+|"
    return first + found.replace(first, "", 1) if first in found else found


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Merge table as sorted arrays: pair key -> rank and new symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        names = byte_symbols()
        self.of_byte = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.pairs: dict[int, tuple[int, int]] | None = None
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK if none) and place in the table of each pair."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK), at

    def survivors(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of every piece: flat symbols and their owners."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owners = np.repeat(np.arange(len(pieces)), lengths)
        done_symbols, done_owners = [], []
        while len(symbols):
            ranks, at = self.find(symbols[:-1], symbols[1:])
            ranks[owners[:-1] != owners[1:]] = NO_RANK
            ranks = np.append(ranks, NO_RANK)
            starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
            least = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            going = np.repeat(least < NO_RANK, sizes)
            if not going.all():
                done_symbols.append(symbols[~going])
                done_owners.append(owners[~going])
                if not going.any():
                    break
            merge = (ranks == np.repeat(least, sizes)) & going
            merge = leftmost(merge)
            first = np.flatnonzero(merge)
            symbols = symbols.copy()
            symbols[first] = self.made[at[first]]
            going[first + 1] = False
            symbols, owners = symbols[going], owners[going]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, own = np.concatenate(done_symbols), np.concatenate(done_owners)
        order = np.argsort(own, kind="stable")
        return flat[order], own[order]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of every piece.  A round goes over all symbols of a piece for one of its
        ranks, so a piece of more than ``LONG`` bytes is merged on its own with a heap."""
        long = [i for i, p in enumerate(pieces) if len(p) > LONG]
        if not long:
            return np.bincount(self.survivors(pieces)[1], minlength=len(pieces))
        out = np.zeros(len(pieces), np.int64)
        short = np.ones(len(pieces), bool)
        short[long] = False
        rest = np.flatnonzero(short)
        out[rest] = np.bincount(self.survivors([pieces[i] for i in rest])[1], minlength=len(rest))
        for i in long:
            out[i] = self.long_count(pieces[i])
        return out

    def long_count(self, piece: bytes) -> int:
        """Symbols left of one piece: its pairs in a heap by rank and place, so each merge looks
        at its two neighbours only."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        pairs, width, n = self.pairs, int(self.width), len(piece)
        symbol = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, at = self.find(np.array(symbol[:-1]), np.array(symbol[1:]))
        first = np.flatnonzero(ranks < NO_RANK)
        heap = list(zip(ranks[first].tolist(), first.tolist(), self.made[at[first]].tolist(), (self.keys[at[first]]).tolist()))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, made, key = heapq.heappop(heap)
            j = after[i] if symbol[i] is not None else n
            if j >= n or symbol[i] * width + symbol[j] != key:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = made, None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                key = made * width + symbol[k]
                if key in pairs:
                    heapq.heappush(heap, (pairs[key][0], i, pairs[key][1], key))
            h = before[i]
            if h >= 0:
                key = symbol[h] * width + made
                if key in pairs:
                    heapq.heappush(heap, (pairs[key][0], h, pairs[key][1], key))
        return left


def leftmost(merge: np.ndarray) -> np.ndarray:
    """Of adjacent marks (overlapping pairs such as in 'aaa') every other one,
    from the left of each run."""
    marks = np.flatnonzero(merge)
    if len(marks) < 2:
        return merge
    new_run = np.append(True, np.diff(marks) != 1)
    run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(marks)), 0))
    out = np.zeros_like(merge)
    out[marks[(np.arange(len(marks)) - run_start) % 2 == 0]] = True
    return out


def splitter(special: list[str]):
    """text -> pre-tokens, and special strings as tokens of their own."""
    import regex

    find = regex.compile(pattern()).findall
    if not special:
        return find
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split
    held = set(special)

    def pre_tokens(text: str) -> list[str]:
        if not any(s in text for s in special):
            return find(text)
        return [t for part in cut(text) for t in ([part] if part in held else find(part))]

    return pre_tokens


def counter(path: str):
    """list of texts -> tokens per text, with the worker's store of pre-tokens."""
    kept = worker_cache("tokens")
    if ("merges", path) not in kept:
        merges = Merges(path)
        kept["merges", path] = merges, splitter(list(merges.special)), {}
    merges, pre_tokens, known = kept["merges", path]

    def count(texts: list[str]) -> list[int]:
        if len(known) > KEPT:
            known.clear()
        known.update(dict.fromkeys(merges.special, 1))
        lists = [pre_tokens(t) for t in texts]
        fresh = list(set().union(*lists).difference(known))
        for i in range(0, len(fresh), 50_000):
            part = fresh[i:i + 50_000]
            known.update(zip(part, merges.counts([t.encode() for t in part]).tolist()))
        out = [sum(map(known.__getitem__, tokens)) for tokens in lists]
        for t in fresh:
            if len(t) > LONG:  # the store is bounded by entries, so it holds short ones
                del known[t]
        return out

    return count


def slices(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    """Consecutive stretches of about ``most`` characters, a text never cut."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 1024,
                 path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    path = path or vocabulary_path()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = StructType([source.schema["doc_id"], StructField("n_bytes", LongType()),
                         StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = batch.column("text")
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            listed = texts.to_pylist()
            tokens = [n for s in slices(listed) for n in count(listed[s])]
            n_tokens = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, n_tokens, pa.compute.greater(n_tokens, limit)], schema.names)

    return source.mapInArrow(run, schema)
