"""64-bit word hashes of Arrow text batches, by whole-array operations.

A word is a run of anything but space and 0x09-0x0D; A-Z count as a-z.  Its hash is
a polynomial of its bytes over 2**64, taken as a difference of prefix sums, mixed
with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of BASE modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes hashed at once; a longer text is a step of its own.
STEP = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_KEPT: dict[str, np.ndarray] = {}


def kept_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > STEP * 2:
        return powers(n, BASE), powers(n, INVERSE)
    if "up" not in _KEPT or len(_KEPT["up"]) < n:
        _KEPT["up"], _KEPT["down"] = powers(STEP * 2, BASE), powers(STEP * 2, INVERSE)
    return _KEPT["up"], _KEPT["down"]


GAPS = np.zeros(256, bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts lying one after the other in ``data`` (bytes), and the
    number of words before each of ``bounds`` (texts' limits, len(texts) + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    in_word = np.append(~GAPS[data], False)
    new = in_word[:-1].copy()
    new[1:] &= ~in_word[:-2]
    limits = bounds[(bounds > 0) & (bounds < n)]
    new[limits] = in_word[limits]  # a word never goes on into the next text
    last = in_word[:-1] & ~in_word[1:]
    last[limits - 1] = in_word[limits - 1]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    up, down = kept_powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    found = (sums[ends] - sums[starts]) * down[starts]
    found = mixed(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return found, np.searchsorted(starts, bounds)


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Steps (first, end, hashes, counts) over consecutive texts: ``counts`` has the
    number of words before each text of the step and after the last."""
    if not len(texts):
        return
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, "right")) - 1)
        end = min(end, len(texts))
        low, high = offsets[first], offsets[end]
        found, counts = hashes(data[low:high], offsets[first:end + 1] - low)
        yield first, end, found, counts
        first = end
