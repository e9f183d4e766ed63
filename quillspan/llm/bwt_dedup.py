"""Suffix-array dedup of bytes by threshold-bounded interval expansion on a Burrows-Wheeler transform.

The contexts of a bucket (see shared_windows) are one string collection with a separator. Its suffixes are sorted, the
transform and its LF mapping derived, and intervals of common prefixes are extended backwards by breadth first: at level t
the intervals of all strings of t symbols whose right bound has no value yet set it to t - 1, so that common prefixes
come by increasing value. The search stops at `length`: bounds that are still unset join suffixes with `length` bytes or more in
common. Of each such group the smallest doc_id keeps its bytes.

Edge cases as in shared_windows: null texts are empty, null ids come first, texts under `length` bytes never change.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .bytes_np import mix
from .shared_windows import Sequences, remove_shared, spans_of

#: A longer gram is shared by chance less often as the corpus grows, but there are more anchors.
LENGTH, GRAM = 50, 24
_A, _B, _C, _D = (np.uint64(x) for x in (0x100000001B3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class Bytes(Sequences):
    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.before, self.raw = buf, off, buf.tobytes()

    def grams(self, a: int, b: int) -> np.ndarray:
        """Hashes of GRAM = 24 bytes: of 8 by doubling, then of three times 8."""
        h = self.buf[a : b + GRAM - 1].astype(np.uint64)
        for n, factor in ((1, _A), (2, _B), (4, _C)):
            h = h[:-n] * factor + h[n:]
        return mix((h[:-16] * _D + h[8:-8]) * _D + h[16:])

    def content(self, a: int, b: int) -> bytes:
        return self.raw[a:b]


def sort_suffixes(s: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of `s` (values below 512) by their first `depth` symbols or more, by doubling from seven symbols a word."""
    n = len(s)
    padded = np.append(s, np.zeros(7, s.dtype)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key)
    k = key[order]
    head = np.append(True, k[1:] != k[:-1])
    del key, k
    place = np.arange(n, dtype=np.int64)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    rank[n] = -1
    have = 7
    while have < depth:
        # Only suffixes that still tie with a neighbour are sorted on.
        tied = ~(head & np.append(head[1:], True))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        suffix = order[at]
        second = rank[np.minimum(suffix + have, n)] + 1
        pair = rank[suffix] * (n + 1) + second
        by = np.argsort(pair)
        order[at] = suffix[by]
        p = pair[by]
        head[at] = np.append(True, p[1:] != p[:-1])
        rank[order[at]] = np.maximum.accumulate(np.where(head[at], at, 0))
        have *= 2
    return order


def bounds_below(s: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order whether it has less than `length` symbols in common with the one before it.

    0 in `s` ends a string; no interval is extended past it.
    """
    n = len(s)
    bwt = s[order - 1]  # before the first symbol stands the last one, an end
    first = s[order]
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int32)
    lf[by] = np.arange(n, dtype=np.int32)
    del by
    is_end = bwt == 0
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    active = np.arange(n, dtype=np.int32)
    owner = np.zeros(n, np.int32)
    slot = np.zeros(n, np.int32)
    mark = np.zeros(n, bool)
    for level in range(1, length + 1):
        if level > 1:
            inner = ~is_end[active]
            active, owner = active[inner], owner[inner]
        if not len(active):
            break
        to = lf[active]
        if len(to) * 8 > n:
            mark[to] = True
            slot[to] = owner
            to = np.flatnonzero(mark).astype(np.int32)
            owner = slot[to]
            mark[to] = False
        else:
            by = np.argsort(to)
            to, owner = to[by], owner[by]
        # An interval ends where the symbol, the interval it came from or the run of places ends.
        begins = first[to]
        ends = np.append((owner[1:] != owner[:-1]) | (begins[1:] != begins[:-1]) | (to[1:] != to[:-1] + 1), True)
        number = np.append(0, np.cumsum(ends[:-1], dtype=np.int32))
        bound = to[ends].astype(np.int64) + 1
        fresh = ~known[bound]
        if level == 1:
            fresh[:] = True
        known[bound] = True
        keep = fresh[number]
        active, owner = to[keep], number[keep]
    return known[:n]


def match_contexts(contexts: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(context, first window, windows) of windows that a context with a smaller id has too."""
    if len(contexts) < 2:
        return []
    size = np.array([len(c) for c in contexts], np.int64)
    # A zero byte stands behind each context and is made an end; other bytes move up by one.
    s = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(size + 1) - 1
    s[ends] = 0
    order = sort_suffixes(s, length + 1)
    bound = bounds_below(s, order, length)
    head = np.flatnonzero(bound)
    of = np.searchsorted(ends, order)
    least = np.repeat(np.minimum.reduceat(ids[of], head), np.diff(np.append(head, len(order))))
    hit = np.flatnonzero((least < ids[of]) & (order + length <= ends[of]))
    starts = np.sort(order[hit])
    if not len(starts):
        return []
    of = np.searchsorted(ends, starts)
    head = np.flatnonzero(np.append(True, (starts[1:] != starts[:-1] + 1) | (of[1:] != of[:-1])))
    own = of[head]
    wide = np.diff(np.append(head, len(starts)))
    return list(zip(own.tolist(), (starts[head] - (ends[own] - size[own])).tolist(), wide.tolist(), strict=True))


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): spans are the removed runs (start, end) in bytes, kept the rest."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")

    def finish(seq: Bytes, covered: np.ndarray, i: int) -> tuple:
        a, b = int(seq.before[i]), int(seq.before[i + 1])
        spans = spans_of(covered)
        kept = seq.raw[a:b] if not len(spans) else seq.buf[a:b][~covered].tobytes()
        return b - a, int(covered.sum()), [{"start": int(x), "end": int(y)} for x, y in spans], kept

    def match(contexts: list[bytes], ids: np.ndarray) -> list[tuple[int, int, int]]:
        return match_contexts(contexts, ids, length)

    ddl = "n_bytes bigint;n_removed bigint;spans array<struct<start:bigint,end:bigint>>;kept binary"
    return remove_shared(docs, Bytes, match, finish, ddl, length, GRAM, text, doc_id)
