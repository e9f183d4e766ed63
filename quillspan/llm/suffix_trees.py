"""Substring dedup of words by prefix-partitioned suffix trees.

The contexts of a bucket (see shared_windows) are sequences of words, numbered within the bucket. Suffixes are parted by prefixes of
variable length: a prefix held by more than GROUP suffixes is lengthened by a word, until it is held by fewer or is as
long as the least repeat; neighbouring prefixes are packed into groups of about GROUP suffixes. Each group's subtree is built by
itself from its sorted suffixes and their common prefixes; its internal nodes of `length` words or more are the repeats. Of each uppermost
such node the smallest doc_id keeps its words.

Edge cases as in shared_windows: null texts have no words, null ids come first, texts under `length` words never change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bytes_np import groups, runs_of, words
from .shared_windows import Sequences, remove_shared, spans_of

LENGTH, GRAM = 13, 4
GROUP = 1 << 16
#: Words to which a subtree tells nodes apart, or the least repeat's if that is longer; deeper ones count as this deep. Bounds a group's table.
DEEPEST = 32


class Words(Sequences):
    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.raw = buf.tobytes()
        found = [(words(buf[off[i] : off[j]], off[i : j + 1] - off[i]), off[i]) for i, j in groups(off, 2_000_000)]
        self.starts = np.concatenate([np.zeros(0, np.int64), *(x[0] + a for x, a in found)])
        self.ends = np.concatenate([np.zeros(0, np.int64), *(x[1] + a for x, a in found)])
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *(x[2] for x, _ in found)])
        self.before = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(x[3]) for x, _ in found)]))).astype(np.int64)

    def grams(self, a: int, b: int) -> np.ndarray:
        return runs_of(self.hashes[a : b + GRAM - 1], GRAM)

    def content(self, a: int, b: int) -> bytes:
        """The words, one space between two."""
        part = self.raw[self.starts[a] : self.ends[b - 1]]
        exact = int(self.ends[b - 1] - self.starts[a]) == int((self.ends[a:b] - self.starts[a:b]).sum()) + b - a - 1
        if exact and not any(c in part for c in b"\t\n\v\f\r"):
            return part
        return b" ".join([self.raw[x:y] for x, y in zip(self.starts[a:b], self.ends[a:b], strict=True)])


def prefix_groups(s: np.ndarray, at: np.ndarray, length: int, most: int) -> Iterator[np.ndarray]:
    """Parts the suffixes at `at` into groups by variable-length prefixes."""
    packed: list[np.ndarray] = []
    held = 0
    todo = [(at, 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) > most and depth < length:
            key = s[part + depth]
            order = np.argsort(key, kind="stable")
            k = key[order]
            head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            many = np.diff(np.append(head, len(k)))
            big = many > most
            todo += [(part[order[a : a + n]], depth + 1) for a, n in zip(head[big], many[big], strict=True)]
            # Prefixes that are small enough are packed in order.
            small = order[np.repeat(~big, many)]
            sizes = many[~big]
            last = 0
            ends = np.cumsum(sizes)
            while last < len(sizes):
                done = ends[last - 1] if last else 0
                nxt = max(last + 1, int(np.searchsorted(ends, done + most, "right")))
                yield part[small[done : ends[nxt - 1]]]
                last = nxt
        elif held + len(part) > most and packed:
            yield np.concatenate(packed)
            packed, held = [part], len(part)
        else:
            packed.append(part)
            held += len(part)
    if packed:
        yield np.concatenate(packed)


def subtree(s: np.ndarray, left: np.ndarray, at: np.ndarray, deepest: int = DEEPEST) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `at` (with `left` words each) in order, and how many words, up to `deepest`, each has in common with the one before."""
    width = min(int(left[at].max()), deepest)
    offsets = np.arange(width)
    inside = offsets[None, :] < left[at][:, None]
    table = np.where(inside, s[np.minimum(at[:, None] + offsets, len(s) - 1)], 0).astype(">u4")
    order = np.argsort(np.ascontiguousarray(table).view(f"S{width * 4}").ravel(), kind="stable")
    table, inside = table[order], inside[order]
    same = (table[1:] == table[:-1]) & inside[1:] & inside[:-1]
    common = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    return at[order], np.append(0, common)


def deep_nodes(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Internal nodes of `least` words or more as (first leaf, last leaf + 1, depth), each parent after its children."""
    out = []
    for a, b in spans_of(common >= least).tolist():
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate([*common[a:b].tolist(), 0], a):
            begin = i - 1
            while stack and stack[-1][1] > depth:
                begin, top = stack.pop()
                out.append((begin, i, top))
            if depth and (not stack or stack[-1][1] < depth):
                stack.append((begin, depth))
    return out


def match_contexts(contexts: list[bytes], ids: np.ndarray, length: int = LENGTH, most: int = GROUP) -> list[tuple[int, int, int]]:
    """(context, first window, windows) of windows that a context with a smaller id has too."""
    if len(contexts) < 2:
        return []
    size = np.array([c.count(b" ") + 1 for c in contexts], np.int64)
    every = pc.split_pattern(pa.array([b" ".join(contexts)], pa.large_binary()), b" ").flatten()
    s = every.dictionary_encode().indices.to_numpy().astype(np.uint32) + np.uint32(1)
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(s))
    of = np.repeat(np.arange(len(size)), size)
    hits = []
    for group in prefix_groups(s, np.flatnonzero(left >= length), length, most):
        leaves, common = subtree(s, left, group, max(DEEPEST, length))
        own = ids[of[leaves]]
        top = -1
        for a, b, _ in reversed(deep_nodes(common, length)):  # parents first
            if top < 0 or a < top_a or b > top_b:
                top, top_a, top_b = a, a, b
                least = own[a:b].min()
                hits.append(leaves[a:b][own[a:b] > least])
    starts = np.sort(np.concatenate([np.zeros(0, np.int64), *hits]))
    if not len(starts):
        return []
    head = np.flatnonzero(np.append(True, (starts[1:] != starts[:-1] + 1) | (of[starts[1:]] != of[starts[:-1]])))
    own = of[starts[head]]
    return list(zip(own.tolist(), (starts[head] - (end - size)[own]).tolist(), np.diff(np.append(head, len(starts))).tolist(), strict=True))


def remove_repeated_words(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): spans are the removed runs (start, end) in words, kept the rest joined by one space."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")

    def finish(seq: Words, covered: np.ndarray, i: int) -> tuple:
        a, b = int(seq.before[i]), int(seq.before[i + 1])
        stay = np.flatnonzero(~covered) + a
        kept = b" ".join([seq.raw[x:y] for x, y in zip(seq.starts[stay].tolist(), seq.ends[stay].tolist(), strict=True)])
        return b - a, int(covered.sum()), [{"start": int(x), "end": int(y)} for x, y in spans_of(covered)], kept

    def match(contexts: list[bytes], ids: np.ndarray) -> list[tuple[int, int, int]]:
        return match_contexts(contexts, ids, length)

    ddl = "n_words bigint;n_removed bigint;spans array<struct<start:bigint,end:bigint>>;kept binary"
    return remove_shared(docs, Words, match, finish, ddl, length, GRAM, text, doc_id)
