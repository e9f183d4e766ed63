"""N-gram Jaccard join by chosen paths: which texts share `threshold` or more of their shingles of `words` words.

Texts with equal shingle sets are one vertex. A set is embedded into BINS min-hash tokens. Per run, a node of the recursion
splits its sets by sampled tokens: each set goes on under each of its tokens whose hash under the node's path is low enough, so
that similar sets share a path with a chance known beforehand. A bucket of at most `small` sets is compared by brute force on
the embedding; a larger one splits again, `depth` times in all. What is then still large is alike, and is compared in
blocks, two at a time. Runs repeat until a pair at the threshold is missed by all with a chance of 1 - recall at most.

Whether a bucket is large is counted before any set moves, by sums that are taken before the shuffle; so no task ever gets a
large bucket, and the sets are dealt once. Pairs of a bucket whose embeddings agree in LIKELY or more leave it as stars: a
row for each set, with the least one that it is joined to. Stars that share a set are joined, which gives candidate groups. Inside each group
exact similarities of whole sets are counted in blocks of bounded bytes and sets, which finds every link of the group, also those that no
run proposed. Classes are the components of the exact links.

Result per row: class_id (the smallest id of the class) and n_links (other distinct texts with a similarity of
the threshold or more). A text of fewer words than a shingle is one shingle. Texts without words, null ones too, are linked to nothing and
are their own class. Null ids count as the smallest id. Repeated rows share a class. An empty table gives an empty result. Very long texts
are read whole; a block holds at least one set. Nothing is capped: large groups are compared in more blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .bytes_np import flat, groups, mix, runs_of, words
from .common import NULL_ID, cut, freed, id_key, packed, release, unpacked

BINS = 128
#: Agreement of embeddings from which two sets are candidates: five standard deviations below a similarity of 0.8.
LIKELY = 0.62
#: How often more than in the first split a token is chosen in a further one.
BRANCH = 1.6
#: Sets of a block of a large bucket, of which a task compares two.
PART = 2048
#: Bytes of sets, and sets, in a block of the exact count.
BLOCK_BYTES, BLOCK_SETS = 8_000_000, 1024
#: The paths of large buckets are broadcast up to so many a level (16 bytes each), else joined by shuffle (AQE splits hot ones).
BROADCAST_PATHS = 500_000
#: Paths that a task counts before it sends the counts on.
AT_ONCE = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    buf, off = flat(texts)
    for i, j in groups(off, 2_000_000):
        _, _, h, before = words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        grams = runs_of(h, n)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            yield np.unique(grams[a : b - n + 1]) if b - a >= n else runs_of(h[a:b], b - a) if b > a else h[:0]


def embed(s: np.ndarray) -> np.ndarray:
    """One token for each bin of hashes: eight bits of the least hash in it, 0 if there is none."""
    out = np.zeros(BINS, np.uint8)
    if len(s):
        bins = (s >> np.uint64(57)).astype(np.int64)
        head = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        out[bins[head]] = (s[head] >> np.uint64(20)) % np.uint64(255) + np.uint64(1)
    return out


def survival(depth: int, branch: float = BRANCH) -> float:
    """The chance that a pair at the threshold shares a bucket after up to `depth` splits of one run.

    Such a pair shares one chosen token in the first split on average and `branch` in a further one, by a Poisson count."""
    p = 1.0
    for k in range(depth):
        p = 1 - math.exp(-p * (branch if k < depth - 1 else 1.0))
    return p


def runs_needed(recall: float, depth: int) -> int:
    """Runs after which such a pair has shared a bucket with the chance `recall` at least."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(depth))))


class Tokens:
    """The tokens of embeddings, scattered, with each row's bound for being chosen."""

    def __init__(self, sig: np.ndarray, threshold: float):
        there = sig > 0
        self.scattered = mix((sig.astype(np.uint64) + np.arange(BINS, dtype=np.uint64) * np.uint64(256)) * _GOLD)
        share = 1 / (threshold * np.maximum(there.sum(axis=1), 1))
        self.there, self.share = there, share[:, None]

    def choose(self, paths: np.ndarray, branch: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(row, new path) of each token that a row's path chooses."""
        at = mix(self.scattered ^ paths[:, None])
        low = np.where(self.there, np.minimum(self.share * branch, 1.0) * 2.0**64, -1.0)
        row, column = np.nonzero(at.astype(np.float64) < low)
        return row, mix(at[row, column] + _GOLD).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 8_000_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows in order of keys: tables of whole groups of `most` bytes or a little more, and where in them the groups begin."""
    held: list[pa.Table] = []
    size = 0

    def heads(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    for b in batches:
        step = max(1, b.num_rows * most // max(1, 2 * b.nbytes))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            held.append(pa.Table.from_batches([part]))
            size += part.nbytes
            if size < most:
                continue
            t = pa.concat_tables(held)
            h = heads(t)
            if len(h) > 1:
                yield t.slice(0, int(h[-1])), h[:-1]
            held = [t.slice(int(h[-1]))]
            size = held[0].nbytes
    if size:
        t = pa.concat_tables(held)
        yield t, heads(t)


class Forest:
    """Disjoint sets of small integers; each is named by its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _count(marks: np.ndarray) -> np.ndarray:
    """How many of each row's BINS marks are set, eight bytes at a time."""
    lanes = np.ascontiguousarray(marks).view(np.uint64).sum(axis=1)
    return ((lanes * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bins with equal tokens among those that either has; rows pairwise."""
    there = a > 0
    return _count((a == b) & there) / np.maximum(_count(there | (b > 0)), 1)


def alike(sig: np.ndarray, likely: float = LIKELY) -> np.ndarray:
    """For each row the least one that a chain of pairs with an agreement of `likely` or more joins it to.

    Rows are compared one by one to all that are not joined to them yet; when all but those of the largest class have been, every pair across classes has been compared."""
    n = len(sig)
    root, size = np.arange(n), np.ones(n, np.int64)
    todo = np.ones(n, bool)
    there = sig > 0
    i = 0
    while i < n:
        todo[i] = False
        share = _count((sig == sig[i]) & there) / np.maximum(_count(there | there[i]), 1)
        near = np.flatnonzero((share >= likely) & (root != root[i]))
        if len(near):
            names = np.unique(np.append(root[near], root[i]))
            size[names[0]] = size[names].sum()
            size[names[1:]] = 0
            root[np.isin(root, names)] = names[0]
        rest = todo & (root != size.argmax())
        i = int(rest.argmax()) if rest.any() else n
    return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, up) of each set of a bucket that is joined to another: the least set of those joined; it has a row itself."""
    for t, head in whole_groups(batches, ["path", "x", "y"]):
        sig, v = _matrix(t.column("sig")), t.column("v").combine_chunks()
        size = np.diff(np.append(head, t.num_rows))
        forest = Forest(t.num_rows)
        for n in np.unique(size).tolist():
            at = head[size == n]
            if n > 64:
                for a in at.tolist():
                    for i, r in enumerate(alike(sig[a : a + n]).tolist()):
                        forest.up[a + i] = a + r
            elif n > 1:
                i, j = np.triu_indices(n, 1)
                step = max(1, 20_000 // len(i))
                for k in range(0, len(at), step):
                    x, y = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                    near = _agreement(sig[x], sig[y]) >= LIKELY
                    for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                        forest.join(p, q)
        root = np.array([forest.find(i) for i in range(t.num_rows)], np.int64)
        joined = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        yield pa.RecordBatch.from_arrays([v.take(pa.array(joined)), v.take(pa.array(root[joined]))], ["v", "up"])


def in_common(holder: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """How many tokens each two of n sets share, above the diagonal (n x n), from the sets that hold each token, in order, and their number.

    Tokens of many sets are counted by products of matrices, those of few pair by pair."""
    both = np.zeros((n, n), np.float32)
    begin = np.cumsum(many) - many
    dense = np.flatnonzero(many * 12 > n)
    width = max(64, 4_000_000 // n)
    for k in range(0, len(dense), width):
        part = dense[k : k + width]
        has = np.zeros((n, len(part)), np.float32)
        pick = np.repeat(begin[part] - (np.cumsum(many[part]) - many[part]), many[part]) + np.arange(int(many[part].sum()))
        has[holder[pick], np.repeat(np.arange(len(part)), many[part])] = 1
        both += has @ has.T
    cells = both.ravel()
    few = (many > 1) & (many * 12 <= n)
    for m in np.unique(many[few]).tolist():
        at = begin[few & (many == m)]
        i, j = np.triu_indices(m, 1)
        step = max(1, 500_000 // len(i))
        for k in range(0, len(at), step):
            own = holder[at[k : k + step, None] + np.arange(m)]
            np.add.at(cells, (own[:, i] * n + own[:, j]).ravel(), np.float32(1))
    return both


def _exact(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each pair of blocks: how many texts each set is linked to, and the least set that links of the pair of blocks join it to."""
    least = round(threshold * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, head in whole_groups(batches, ["g", "x", "y"]):
            v, copies = t.column("v").combine_chunks(), t.column("texts").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in t.column("s").to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            x, y, own = t.column("x").to_numpy(), t.column("y").to_numpy(), t.column("block").to_numpy()
            links = np.zeros(len(v), np.int64)
            forest = Forest(len(v))
            for a, b in zip(head.tolist(), np.append(head[1:], t.num_rows).tolist(), strict=True):
                n = b - a
                if n < 2:
                    continue
                every = np.concatenate(sets[a:b])
                order = np.argsort(every, kind="stable")
                e = every[order]
                begin = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
                many = np.diff(np.append(begin, len(e)))
                holder = np.repeat(np.arange(n), size[a:b])[order]
                both = in_common(holder, many, n)
                for i in range(0, n, 256):  # some rows at a time
                    c = np.rint(both[i : i + 256]).astype(np.int64)
                    ok = c * 1_000_000 >= least * (size[a + i : a + i + 256][: len(c), None] + size[None, a:b] - c)
                    ok &= np.arange(i, i + len(c))[:, None] < np.arange(n)[None]
                    if x[a] != y[a]:  # within a block its own pair of blocks counts
                        ok &= own[a + i : a + i + len(c), None] != own[None, a:b]
                    links[a + i : a + i + len(c)] += ok @ copies[a:b]
                    links[a:b] += copies[a + i : a + i + len(c)] @ ok
                    for p, q in zip(*np.nonzero(ok), strict=True):
                        forest.join(a + i + int(p), a + int(q))
            root = [forest.find(i) for i in range(len(v))]
            yield pa.RecordBatch.from_arrays([v, v.take(pa.array(root)), pa.array(links)], ["v", "up", "links"])

    return run


def joined(stars: DataFrame) -> DataFrame:
    """(v, root) of stars (v, ups): all sets that each is joined to, itself included if it is the centre of a star.

    A set hangs from the least of its centres; only links between centres go through rounds of components."""
    links = stars.where(F.size("ups") > 1).select(F.col("ups")[0].alias("a"), F.explode(F.slice("ups", 2, F.size("ups"))).alias("b")).distinct()
    links = cut(links)
    hung = stars.select("v", F.col("ups")[0].alias("up"))
    if not links.limit(1).count():
        release(links)
        return hung.withColumnRenamed("up", "root")
    labels = components(links)
    release(links)
    out = hung.join(labels.select(F.col("v").alias("up"), "root"), "up", "left").select("v", F.coalesce("root", "up").alias("root"))
    out._uses = labels
    return out


KIND = "path long, x int, y int, v binary, sig binary"


def _is_in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def walk(sig: np.ndarray, start: np.uint64, threshold: float, large: list[np.ndarray], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of one run (level, rows, their paths): those that stop at each level, as their bucket there is none of `large`, and those
    that go on to the first level of which `large` tells nothing, or stop in a large bucket after `depth` splits."""
    row, path = Tokens(sig, threshold).choose(np.full(len(sig), start))
    for level, paths in enumerate(large, 1):
        goes_on = _is_in(path, paths)
        yield level, row[~goes_on], path[~goes_on]
        row, path = row[goes_on], path[goes_on]
        if level < depth:
            sub, path = Tokens(sig[row], threshold).choose(path.view(np.uint64), BRANCH)
            row = row[sub]
    yield len(large) + 1, row, path


def _dealt(given: DataFrame, starts: np.ndarray, threshold: float, depth: int, small: int) -> DataFrame | None:
    """The rows of all buckets (KIND), by walks that know the large ones; None if these are too many to broadcast."""
    large: list[np.ndarray] = []
    sums: list[np.ndarray] = []

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            path, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(path), pa.array(n)], ["path", "n"])

        for b in batches:
            sig = _matrix(b.column("sig"))
            for i in range(0, b.num_rows, 1000):
                for start in starts:
                    held += [path for level, _, path in walk(sig[i : i + 1000], start, threshold, told.value[0], depth) if level > len(told.value[0])]
                if sum(map(len, held)) > AT_ONCE:
                    yield summed()
        yield summed()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, sizes = told.value
        for b in batches:
            sig = _matrix(b.column("sig"))
            for i in range(0, b.num_rows, 1000):
                for start in starts:
                    for level, row, path in walk(sig[i : i + 1000], start, threshold, paths, depth):
                        x = y = np.zeros(len(row), np.int64)
                        if level > depth:  # blocks of a bucket that is large to the end meet two at a time
                            parts = -(-sizes[-1][np.searchsorted(paths[-1], path)] // PART)
                            own = np.array([int.from_bytes(b.column("v")[k].as_py()[:6], "big") for k in (row + i).tolist()], np.int64) % parts
                            at = np.repeat(np.arange(len(row)), parts)
                            other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                            row, path, x, y = row[at], path[at], np.minimum(own[at], other), np.maximum(own[at], other)
                        if len(row):
                            at = pa.array(row + i)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(path), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), b.column("v").take(at), b.column("sig").take(at)],
                                ["path", "x", "y", "v", "sig"]
                            )

    for _ in range(depth):
        told = given.sparkSession.sparkContext.broadcast((large, sums))
        # Sums are taken before the shuffle; a path says the same of a bucket's size to all its sets.
        hot = cut(given.select("sig").mapInArrow(freed(counts), "path long, n long").groupBy("path").agg(F.sum("n").alias("n")).where(F.col("n") > small))
        n = hot.limit(BROADCAST_PATHS + 1).count()
        found = hot.orderBy("path").toArrow() if 0 < n <= BROADCAST_PATHS else None
        release(hot)
        if n > BROADCAST_PATHS:
            return None
        large.append(found.column("path").to_numpy() if n else np.zeros(0, np.int64))
        sums.append(found.column("n").to_numpy() if n else np.zeros(0, np.int64))
        if not n:
            break
    told = given.sparkSession.sparkContext.broadcast((large, sums))
    return given.mapInArrow(freed(rows), KIND)


def _dealt_by_join(given: DataFrame, starts: np.ndarray, threshold: float, depth: int, small: int, used: list[DataFrame]) -> DataFrame:
    """As _dealt, the large buckets being joined to the rows of each level."""
    none = np.zeros(0, np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _matrix(b.column("sig"))
            for i in range(0, b.num_rows, 1000):
                for start in starts:
                    for _, row, path in walk(sig[i : i + 1000], start, threshold, [none], 1):
                        at = pa.array(row + i)
                        yield pa.RecordBatch.from_arrays([pa.array(path), b.column("v").take(at), b.column("sig").take(at)], ["path", "v", "sig"])

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, path = Tokens(_matrix(b.column("sig")), threshold).choose(b.column("path").to_numpy().view(np.uint64), BRANCH)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(path), b.column("v").take(at), b.column("sig").take(at)], ["path", "v", "sig"])

    zero = F.lit(0).cast("int")
    level, out = given.mapInArrow(first, "path long, v binary, sig binary"), None
    for d in range(1, depth + 1):
        hot = cut(level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small))
        told = level.join(hot, "path", "left")
        stop = told.where("n is null").select("path", zero.alias("x"), zero.alias("y"), "v", "sig")
        out = stop if out is None else out.union(stop)
        rest = cut(told.where("n is not null"))
        used += [hot, rest]
        level = rest.select("path", "v", "sig").mapInArrow(further, "path long, v binary, sig binary") if d < depth else rest
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = level.withColumn("part", F.pmod(F.xxhash64("v"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return out.union(dealt.select("path", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "v", "sig"))


def candidate_groups(sets: DataFrame, threshold: float, recall: float, depth: int, small: int) -> DataFrame | None:
    """(v, root) of candidate groups, a cut, from (v, sig); None if there are no candidates."""
    starts = mix(np.arange(1, runs_needed(recall, depth) + 1, dtype=np.uint64))
    given = sets.select("v", "sig")
    used: list[DataFrame] = []
    rows = _dealt(given, starts, threshold, depth, small) or _dealt_by_join(given, starts, threshold, depth, small, used)
    stars = rows.repartition("path", "x", "y").sortWithinPartitions("path", "x", "y", "v").mapInArrow(freed(_stars), "v binary, up binary")
    ups = cut(stars.groupBy("v").agg(F.array_sort(F.collect_set("up")).alias("ups")))
    release(*used)
    out = None
    if ups.limit(1).count():
        found = joined(ups)
        out = cut(found)
        release(getattr(found, "_uses", None))
    release(ups)
    return out


def near_classes(docs: DataFrame, threshold: float = 0.8, words_in: int = 5, recall: float = 0.999, depth: int = 3, small: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_raw, _id, _th, root, class_id, n_links), a row for each row of `docs`: _raw is its id, _th xxhash64 of its text.

    root names the class, whatever ids its members have; null for a text without words, a class of its own."""
    base = docs.select(F.col(doc_id).alias("_raw"), id_key(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, sig, size = [], [], []
            for s in shingle_sets(b.column("_text"), words_in):
                v.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sig.append(embed(s).tobytes())
                size.append(len(s))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(v, pa.binary()), pa.array(sig, pa.binary()), pa.array(size, pa.int64())], ["_raw", "_id", "_th", "v", "sig", "size"])

    from pyspark.sql.types import StructType

    signed = cut(base.mapInArrow(freed(sign), StructType([base.schema["_raw"], *StructType.fromDDL("_id long, _th long, v binary, sig binary, size long").fields])))
    # One row for each set, with the document that stands for it and how many different texts have it.
    texts = signed.where("v is not null").groupBy("v", "_th").agg(F.min("_id").alias("_id"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    sets = cut(texts.groupBy("v").agg(F.min(F.struct("_id", "_th")).alias("rep"), F.first("sig").alias("sig"), F.first("size").alias("size"), F.count(F.lit(1)).alias("texts")))
    loose = candidate_groups(sets, threshold, recall, depth, small)
    known = sets.select("v", "rep", "texts")
    if loose is None:
        classes = known.select("v", F.col("v").alias("root"), "rep", "texts", F.lit(0).cast("long").alias("links"))
        exact = None
    else:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = pa.array([s.tobytes() for s in shingle_sets(b.column("_text"), words_in)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*names, "s"])

        names = ["v", "g", "texts", "block", "blocks"]
        wanted = loose.select("v", F.col("root").alias("g")).join(sets.select("v", "rep._id", "rep._th", "size", "texts"), "v")
        blocks = wanted.groupBy("g").agg(F.greatest(F.ceil(F.sum(F.col("size") * 8 + 64) / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
        wanted = wanted.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
        # Repeated rows are read once.
        once = F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id"))
        whole = base.select("_id", "_th", "_text").join(wanted, ["_id", "_th"]).withColumn("_once", once).where("_once = 1").select(*names, "_text").mapInArrow(
            freed(read), "v binary, g binary, texts long, block int, blocks int, s binary"
        )
        dealt = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "g", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "v", "texts", "s"
        )
        counted = dealt.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "v").mapInArrow(freed(_exact(threshold)), "v binary, up binary, links long")
        exact = cut(counted.groupBy("v").agg(F.sum("links").alias("links"), F.array_sort(F.collect_set("up")).alias("ups")))
        found = joined(exact.select("v", "ups"))
        linked = exact.select("v", "links").join(found, "v")
        classes = known.join(linked, "v", "left").select("v", F.coalesce("root", "v").alias("root"), "rep", "texts", F.coalesce("links", F.lit(0)).alias("links"))
    least = classes.groupBy("root").agg(F.min("rep._id").alias("class_id"))
    told = cut(classes.join(least, "root").select("v", "root", "class_id", (F.col("links") + F.col("texts") - 1).alias("n_links")))
    if loose is not None:
        release(getattr(found, "_uses", None))
    release(loose, exact, sets)
    rows = signed.select("_raw", "_id", "_th", "v")
    some = rows.where("v is not null").join(told, "v").select("_raw", "_id", "_th", "root", "class_id", "n_links")
    return some.union(rows.where("v is null").select("_raw", "_id", "_th", F.col("v").alias("root"), F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """(id, class_id, n_links), a row for each row of `docs`."""
    found = near_classes(docs, text=text, doc_id=doc_id, **how)
    return found.select(F.col("_raw").alias(doc_id), F.when(F.col("class_id") != NULL_ID, F.col("class_id")).alias("class_id"), "n_links")


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` that stay: of each class the one with the smallest id (then hash); documents without words all stay, once."""
    found = near_classes(docs, text=text, doc_id=doc_id, **how)
    me = F.struct("_id", "_th")
    # Ids don't tell classes apart: null ids count as one, and different texts may share an id.
    stay = found.groupBy("root", F.when(F.col("root").isNull(), me).alias("alone")).agg(F.min(me).alias("k")).select("k._id", "k._th")
    row = F.col("row")
    keyed = packed(docs).withColumns({"_id": id_key(row.getField(doc_id)), "_th": F.xxhash64(row.getField(text))}).join(stay, ["_id", "_th"])
    once = F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id"))
    return unpacked(keyed.withColumn("_once", once).where("_once = 1"), docs.columns)
