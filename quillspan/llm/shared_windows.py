"""The frame of the two substring dedup operators: brings together what may hold equal windows of L symbols.

Any two equal windows have the same anchor, the k-gram of the least hash in them (leftmost if equal). A context is the
run of consecutive windows of a text that share an anchor's hash. So windows need comparing only inside an anchor's group of contexts:

1. texts are dealt to blocks of about BLOCK bytes by id; each block sends its distinct anchors to buckets of hashes,
2. a bucket returns to each block which of its anchors occur in another document, and which of them HOT blocks or more hold,
3. blocks send the contexts of such anchors, each distinct one once with its smallest doc_id, to buckets by the anchor's hash,
4. in a bucket a matcher (a Burrows-Wheeler transform, suffix trees) finds each context's windows that a document
   with a smaller id holds; contexts that are the only ones of their anchor need none, and the others are matched in collections of
   about COLLECTION bytes, by anchor,
5. blocks cut out what the found windows cover.

No group is ever gathered that grows with the copies of one text: a block sends an anchor and a context once however
often it holds them, and later documents of the same block are settled there. The contexts of a hot anchor, which stands in a passage with many
different neighbours, are split by where the anchor is in a window and by what all such windows have in common, so that they are dealt over many
buckets. The number of blocks and buckets follows the bytes of the input, so their size does not; a block sends a row to each bucket for which it
has something, at most one for each anchor. Nothing is dropped, and all comparisons of windows are exact: hashes only propose.

Null texts count as empty. Null ids count as the smallest id. Rows with equal ids never take windows from each other, and
each repeated row gets its result. An empty table gives an empty result. A very long text is read in pieces, in a block of its own size. Only
the id and the text are read, so no other column's name can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import PIECE, flat, mix
from .common import id_key, text_bytes, text_or_empty

BLOCK = 8_000_000
#: Bits of an anchor's hash that are sent. Fewer only propose more: every found window is compared whole.
SENT = np.uint64((1 << 48) - 1)
#: Windows that a context has at most; longer runs (as of one letter) are cut.
LONGEST = 1024
#: Blocks that hold an anchor from which its contexts are split, and into how many parts by the anchor's place in a window.
HOT, PARTS = 50, 5
#: Bytes of contexts that a matcher gets at a time: its arrays stay in the caches.
COLLECTION = 200_000


class Sequences:
    """The symbols of a block's texts: `before` counts the symbols before each text."""

    before: np.ndarray

    def grams(self, a: int, b: int) -> np.ndarray:
        """A hash of the k-gram that starts at each symbol from a to b."""
        raise NotImplementedError

    def content(self, a: int, b: int) -> bytes:
        """The symbols from a to b in a form in which the matcher reads them."""
        raise NotImplementedError


def runs(seq: Sequences, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of all texts: first window, number of windows, the anchor's hash, the text."""
    width = length - k + 1
    n = int(seq.before[-1]) - length + 1
    # Windows that span two texts are none.
    ok = np.zeros(max(n, 0) + 1, np.int32)
    has = np.diff(seq.before) >= length
    np.add.at(ok, seq.before[:-1][has], 1)
    np.add.at(ok, (seq.before[1:] - length + 1)[has], -1)
    ok = np.cumsum(ok)[:-1] > 0
    firsts, hashes = [], []
    step = PIECE // 2
    previous: tuple[bool, int] = (False, 0)
    last_stop: list[int] = []
    stops = []
    for a in range(0, n, step):
        b = min(n, a + step)
        h = seq.grams(a, b + width - 1)
        m = h
        have = 1
        while have * 2 <= width:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < width:
            m = np.minimum(m[: b - a], m[width - have : width - have + b - a])
        valid = ok[a:b]
        new = np.empty(b - a, bool)
        new[1:] = (m[1:] != m[:-1]) | ~valid[:-1]
        new[0] = not previous[0] or previous[1] != int(m[0])
        new |= np.arange(a, b) % LONGEST == 0
        new[np.minimum(seq.before[:-1][(seq.before[:-1] >= a) & (seq.before[:-1] < b)] - a, b - a - 1)] = True
        at = np.flatnonzero(new & valid)
        # A run ends where the next begins or at the first invalid window.
        ends = np.flatnonzero(~valid & np.append(previous[0], valid[:-1]))
        firsts.append(at + a)
        hashes.append(m[at] & SENT)
        stops.append(ends + a)
        previous = (bool(valid[-1]), int(m[-1]))
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    first, h, stop = np.concatenate(firsts), np.concatenate(hashes), np.append(np.concatenate(stops), n)
    nxt = np.append(first[1:], n)
    end = np.minimum(nxt, stop[np.searchsorted(stop, first, "right")]) if len(first) else nxt
    return first, end - first, h, np.searchsorted(seq.before, first, "right") - 1


def grams_at(seq: Sequences, k: int, at: np.ndarray) -> np.ndarray:
    """A hash of the k-gram at each place, in pieces of the text."""
    order = np.argsort(at, kind="stable")
    places, out = at[order], np.empty(len(at), np.uint64)
    last, i = int(seq.before[-1]) - k + 1, 0
    while i < len(places):
        a = int(places[i])
        b = min(a + PIECE // 2, last)
        j = int(np.searchsorted(places, b))
        out[order[i:j]] = seq.grams(a, b)[places[i:j] - a]
        i = j
    return out


def split_hot(seq: Sequences, length: int, k: int, found: tuple, hot: np.ndarray) -> tuple:
    """Contexts as runs() finds them, those of hot anchors (ascending) split into runs of windows with the anchor in one part of them.

    Such windows share a core around the anchor, whose hash becomes the key; equal windows have their anchor in the same place and
    so the same key."""
    first, n, h, of = found
    if not len(hot) or not len(h):
        return found
    is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
    if not is_hot.any():
        return found
    width = length - k + 1
    step = -(-width // PARTS)
    a, m, key, text = (x[is_hot] for x in (first, n, h, of))
    run = np.arange(len(a))

    def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, place) of `sizes` places from each run's first."""
        own = np.repeat(run, sizes)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + a[own]

    # Where in each run's windows its anchor stands, and for each window the first such place in it.
    own, at = places(m + width - 1)
    is_anchor = (grams_at(seq, k, at) & SENT) == key[own]
    spread = np.int64(int(seq.before[-1]) + 1)
    anchors = (own * spread + at)[is_anchor]
    own, start = places(m)
    anchor = anchors[np.searchsorted(anchors, own * spread + start)] - own * spread
    part = (anchor - start) // step
    new = np.append(True, (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))
    head = np.flatnonzero(new)
    # The core is as long as a window, less the places that the anchor may take in it; grams side by side cover it.
    begin, core = anchor[head] - part[head] * step, length - step + 1
    keys = mix(key[own[head]] + part[head].astype(np.uint64))
    for x in [*range(0, core - k, k), core - k]:
        keys = mix(keys * np.uint64(3) + grams_at(seq, k, begin + x))
    cold = ~is_hot
    out = (
        np.concatenate([first[cold], start[head]]), np.concatenate([n[cold], np.diff(np.append(head, len(own)))]), np.concatenate([h[cold], keys & SENT]),
        np.concatenate([of[cold], text[own[head]]])
    )
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


def _sorted_rows(table: pa.Table) -> pa.Table:
    """The rows of a block in an order that does not depend on how they came."""
    return table.take(pc.sort_indices(table, [("_id", "ascending"), ("_text", "ascending")])) if table.num_rows > 1 else table


def _twice(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and which of them occur with more than one id."""
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    if not len(head):
        return h, np.zeros(0, bool)
    return h[head], np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)


def _split(key: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) of each."""
    bucket = (key % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    if not len(b):
        return order, []
    head = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    return order, [(int(b[i]), int(i), int(j)) for i, j in zip(head, np.append(head[1:], len(b)), strict=True)]


def pack(values: np.ndarray, size: int | None = None) -> bytes:
    """The values' lowest `size` bytes, all first bytes before all second ones: shuffle compression finds the runs in them."""
    cells = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return cells[:, :size].T.tobytes()


def unpack(data: bytes, kind: type, size: int | None = None) -> np.ndarray:
    width = np.dtype(kind).itemsize
    size = size or width
    cells = np.zeros((len(data) // size, width), np.uint8)
    cells[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return cells.view(kind).ravel()


def _all(table: pa.Table, name: str, kind: type, size: int | None = None) -> list[np.ndarray]:
    return [unpack(x, kind, size) for x in table.column(name).to_pylist()]


def dealt(rows: DataFrame, by: str = "_block") -> DataFrame:
    """(by, data) from rows: what a task has for a block as one compressed table. The shuffle moves about half of the texts' bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(b.schema.get_field_index(by)).to_numpy()
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else order
            parts = []
            for i, j in zip(head, np.append(head[1:], len(key)), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(b.take(pa.array(order[i:j])))
                parts.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(key[order][head], pa.int32()), pa.array(parts, pa.binary())], [by, "data"])

    return rows.mapInArrow(run, f"{by} int, data binary")


def undealt(table: pa.Table) -> pa.Table:
    """The rows of a block again."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("data").to_pylist()])


def remove_shared(
    docs: DataFrame, sequences: Callable[[np.ndarray, np.ndarray], Sequences], matcher: Callable[[list[bytes], np.ndarray], list[tuple[int, int, int]]],
    finish: Callable[[Sequences, np.ndarray, int], tuple[list, pa.Array]], finished: str, length: int, k: int, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Removes from every text the symbols covered by a window of `length` symbols that a document with a smaller id also has.

    matcher(contexts, ids) returns (context, first window, windows) for windows that a context with a smaller id has too.
    finish(sequences, covered, text) returns the values of the columns `finished` (DDL) for one text.
    Result: the id column, then those columns.
    """
    base = docs.select(F.col(doc_id), id_key(doc_id).alias("_id"), text_or_empty(text).alias("_text"))
    blocks = max(1, -(-text_bytes(docs, text) // BLOCK))
    buckets = blocks * 2
    base = dealt(base.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")))

    def load(table: pa.Table) -> tuple[pa.Table, Sequences, np.ndarray]:
        table = _sorted_rows(undealt(table))
        seq = sequences(*flat(table.column("_text")))
        return table, seq, table.column("_id").to_numpy()

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        _, seq, ids = load(table)
        _, _, h, of = runs(seq, length, k)
        h, multi = _twice(h, ids[of])
        order, parts = _split(h >> np.uint64(8), blocks)
        h, multi = h[order], multi[order]
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in parts], pa.int32()), "block": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                "h": pa.array([pack(h[i:j], 6) for _, i, j in parts], pa.binary()),
                "multi": pa.array([np.packbits(multi[i:j]).tobytes() for _, i, j in parts], pa.binary())
            }
        )

    def shared_anchors(table: pa.Table) -> pa.Table:
        hs = _all(table, "h", np.uint64, 6)
        n = [len(x) for x in hs]
        multi = np.concatenate([np.unpackbits(x, count=m).astype(bool) for x, m in zip(_all(table, "multi", np.uint8), n, strict=True)])
        h = np.concatenate(hs)
        _, kind, holders = np.unique(h, return_inverse=True, return_counts=True)
        found, hot = multi | (holders[kind] > 1), holders[kind] >= HOT
        ends = np.cumsum(n)
        sent = lambda which: pa.array([pack(h[i - m : i][which[i - m : i]], 6) for i, m in zip(ends, n, strict=True)], pa.binary())
        return pa.table({"_block": table.column("block"), "h": sent(found), "hot": sent(hot)})

    def send_contexts(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "block": [], "ids": [], "at": [], "keys": [], "sizes": [], "data": []}
        if left.num_rows and right.num_rows:
            _, seq, ids = load(left)
            first, n, h, of = runs(seq, length, k)
            wanted, hot = (np.sort(np.concatenate(_all(right, c, np.uint64, 6))) for c in ("h", "hot"))
            pick = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h) if len(wanted) else np.zeros(0, np.int64)
            first, n, h, of = split_hot(seq, length, k, (first[pick], n[pick], h[pick], of[pick]), hot)
            pick = np.arange(len(h))
            # Rows are in order of ids, so the first of equal contexts is the one with the smallest id.
            seen: set[bytes] = set()
            keep, data = [], []
            for i, a, b in zip(pick.tolist(), first[pick].tolist(), (first + n + length - 1)[pick].tolist(), strict=True):
                c = seq.content(a, b)
                if c not in seen:
                    seen.add(c)
                    keep.append(i)
                    data.append(c)
            kept = np.array(keep, np.int64)
            order, parts = _split(h[kept] >> np.uint64(8), buckets)
            for bucket, i, j in parts:
                part = order[i:j]
                own = kept[part]
                out["bucket"].append(bucket)
                out["block"].append(key[0].as_py())
                out["ids"].append(pack(ids[of[own]].astype(np.int64)))
                out["at"].append(pack(first[own]))
                out["keys"].append(pack(h[own], 3))
                out["sizes"].append(pack(np.append([len(data[x]) for x in part], n[own]).astype(np.int32)))
                out["data"].append(pa.compress(b"".join([data[x] for x in part]), codec="zstd", asbytes=True))
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("ids", "at", "keys", "sizes", "data")]]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: dict[bytes, int] = {}
        least: list[int] = []
        anchor: list[int] = []
        seen: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for block, ids, at, keys, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "at", "keys", "sizes", "data")), strict=True):
                ids, at, keys, sizes = unpack(ids, np.int64), unpack(at, np.int64), unpack(keys, np.uint64, 3), unpack(sizes, np.int32)
                size, n = sizes[: len(ids)], sizes[len(ids) :]
                data = pa.decompress(data, int(size.sum()), codec="zstd", asbytes=True)
                numbers = np.empty(len(ids), np.int64)
                end = 0
                for x, (i, key, m) in enumerate(zip(ids.tolist(), keys.tolist(), size.tolist(), strict=True)):
                    c = data[end : end + m]
                    end += m
                    number = where.setdefault(c, len(least))
                    if number == len(least):
                        least.append(i)
                        anchor.append(key)
                    elif i < least[number]:
                        least[number] = i
                    numbers[x] = number
                seen.append((block, ids, at, n, numbers))
        smallest = np.array(least, np.int64)
        contexts = list(where)
        # Some bits of the anchors' hashes tell them apart well enough: a collision only matches more.
        _, kind, many = np.unique(np.array(anchor, np.int64), return_inverse=True, return_counts=True)
        several = many[kind] > 1
        collections = 1 + sum(len(contexts[x]) for x in np.flatnonzero(several).tolist()) // COLLECTION
        hits = [np.zeros((0, 3), np.int64)]
        for k in range(collections):
            own = np.flatnonzero(several & (kind % collections == k))
            part = np.array(matcher([contexts[x] for x in own.tolist()], smallest[own]), np.int64).reshape(-1, 3)
            part[:, 0] = own[part[:, 0]]
            hits.append(part)
        found = np.concatenate(hits)
        found = found[np.argsort(found[:, 0], kind="stable")]
        for block, ids, at, n, numbers in seen:
            later = ids > smallest[numbers]
            # The rest are the contexts' first documents: theirs are the matcher's windows.
            mine = np.flatnonzero(~later)
            lo, hi = np.searchsorted(found[:, 0], numbers[mine]), np.searchsorted(found[:, 0], numbers[mine], "right")
            many = hi - lo
            rows = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            start = np.concatenate([at[later], np.repeat(at[mine], many) + found[rows, 1]])
            wide = np.concatenate([n[later].astype(np.int64), found[rows, 2]])
            if len(start):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(start)], pa.binary()), pa.array([pack(wide.astype(np.int32))], pa.binary())], ["_block", "at", "n"])

    names = [f.split()[0] for f in finished.split(";")]

    def cut_out(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table, seq, ids = load(left)
        total = int(seq.before[-1])
        edge = np.zeros(total + 1, np.int32)
        hot_anchors = np.sort(np.concatenate([np.zeros(0, np.uint64), *_all(right.filter(pc.is_valid(right.column("hot"))), "hot", np.uint64, 6)]))
        first, n, h, of = split_hot(seq, length, k, runs(seq, length, k), hot_anchors)
        right = right.filter(pc.is_valid(right.column("at")))

        def cover(a: np.ndarray, windows: np.ndarray) -> None:
            np.add.at(edge, a, 1)
            np.add.at(edge, a + windows + length - 1, -1)

        at = np.concatenate([np.zeros(0, np.int64), *_all(right, "at", np.int64)])
        wide = np.concatenate([np.zeros(0, np.int32), *_all(right, "n", np.int32)]).astype(np.int64)
        cover(at, wide)
        # What equals a context that this block holds in an earlier document, and repeats of it in the same one.
        told = np.searchsorted(first, at, "right") - 1
        kinds, multi = _twice(h, ids[of]) if len(h) else (h, np.zeros(0, bool))
        again = kinds[multi]
        hot = np.isin(h, np.union1d(again, h[told]))
        by_run: dict[int, list[tuple[int, int]]] = {}
        for r, a, w in zip(told.tolist(), (at - first[told]).tolist(), wide.tolist(), strict=True):
            by_run.setdefault(r, []).append((a, w))
        seen: dict[bytes, int] = {}
        more_at, more_n = [], []
        for i in np.flatnonzero(hot).tolist():
            c = seq.content(int(first[i]), int(first[i] + n[i] + length - 1))
            r = seen.setdefault(c, i)
            if r == i:
                continue
            if ids[of[i]] > ids[of[r]]:
                more_at.append(int(first[i]))
                more_n.append(int(n[i]))
            else:
                for a, w in by_run.get(r, ()):
                    more_at.append(int(first[i]) + a)
                    more_n.append(w)
        cover(np.array(more_at, np.int64), np.array(more_n, np.int64))
        covered = np.cumsum(edge[:-1]) > 0
        values = [finish(seq, covered[seq.before[i] : seq.before[i + 1]], i) for i in range(table.num_rows)]
        columns = {doc_id: table.column(doc_id)}
        for x, name in enumerate(names):
            columns[name] = pa.array([v[x] for v in values], out_schema.field(name).type)
        return pa.table(columns)

    ddl = ", ".join(finished.split(";"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    result = StructType([docs.schema[doc_id], *StructType.fromDDL(ddl).fields])
    out_schema = to_arrow_schema(result)
    anchors = base.groupBy("_block").applyInArrow(send_anchors, "bucket int, block int, h binary, multi binary")
    shared = anchors.groupBy("bucket").applyInArrow(shared_anchors, "_block int, h binary, hot binary")
    contexts = base.groupBy("_block").cogroup(shared.groupBy("_block")).applyInArrow(send_contexts, "bucket int, block int, ids binary, at binary, keys binary, sizes binary, data binary")
    found = contexts.groupBy("bucket").applyInArrow(match, "_block int, at binary, n binary")
    none = F.lit(None).cast("binary")
    told = found.withColumn("hot", none).unionByName(shared.where(F.length("hot") > 0).select("_block", none.alias("at"), none.alias("n"), "hot"))
    return base.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(cut_out, result)


def spans_of(covered: np.ndarray) -> np.ndarray:
    """(from, to) of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)
