"""Texts of Arrow batches as flat byte arrays, and words in them, by numpy.

Work goes in pieces of about PIECE bytes whatever the length of a text, so that memory stays bounded and arrays stay
in the caches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 17
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_RNG = np.random.default_rng(20240229)
_OF_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int, step: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters a linear hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def groups(off: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of `most` bytes at most, or of one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of all texts, and the number of words before each text.

    No word spans two texts. Equal words have equal hashes; others differ but for chance.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    space = SPACE[buf]
    first = ~space
    first[1:] &= space[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = ~space[heads]
    last = ~space
    last[:-1] &= space[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    table = powers(int((ends - starts).max(initial=1)))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        a, b = starts[i], ends[j - 1]
        at = starts[i:j] - a
        v = _OF_BYTE[buf[a:b]]
        inside = np.arange(b - a) - np.repeat(at, np.diff(np.append(at, b - a)))
        v *= table[np.minimum(inside, len(table) - 1)]
        v[space[a:b]] = 0
        hashes[i:j] = np.add.reduceat(v, at)
        i = j
    return starts, ends, mix(hashes + (ends - starts).astype(np.uint64) * _STEP), np.searchsorted(starts, off)


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _STEP + hashes[i : i + n]
    return mix(out)


def inside_texts(before: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k values lie in one text, given the number of values before each text."""
    n = max(0, int(before[-1]) - k + 1)
    ok = np.ones(n, bool)
    for back in range(1, k):  # a window that starts less than k values before a text's end
        bad = before[1:] - back
        ok[bad[(bad >= 0) & (bad < n)]] = False
    return ok
