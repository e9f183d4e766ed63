"""LM scoring by cross-entropy difference of two matched n-gram models over words.

The vocabulary, shared by both models, is every distinct word of all texts and the end of a text; it and the tables of
n-grams grow with the corpus. Both models interpolate 3-grams, 2-grams, words and the uniform distribution: an order's
probability is (count + MASS * probability of the order below) / (count of the context + MASS); words back off to
the uniform distribution with the vocabulary's size as mass, so that a word that a model lacks still has a share.
A text is scored by what all other rows say: its own counts are taken from both models beforehand, as a model of long
n-grams else knows each text that it was made of by heart.

No table of n-grams is gathered anywhere:

1. texts and labels are dealt to blocks of about BLOCK bytes by id; each block sends its distinct n-grams with their
   counts, once however often it holds them, to buckets of hashes,
2. a bucket sums them and returns the sums to each block in the order in which they came,
3. blocks score their texts.

N-grams are told apart by 48 bits of a hash. Null texts and those without words have no tokens: n_tokens 0, the losses and the
score null, kept false; they count nowhere. Repeated rows count as often as they occur. Null ids are kept and dealt by their text.
An empty table gives an empty result. A very long text is one row of a block of its own size. Only the id and the text are read, so no other column's name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import flat, mix, words
from .common import id_key, text_bytes, text_or_empty
from .shared_windows import dealt, pack, undealt, unpack

BLOCK = 5_000_000
ORDER, MASS = 3, 4.0
BEGIN, END = np.uint64(0x51ED270B35A9F0C3), np.uint64(0xA24BAED4963EE407)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SIX = np.uint64((1 << 48) - 1)


class Grams:
    """The n-grams of a block: for each word and end of a text in order, the keys of those of 1 to ORDER words that end there."""

    def __init__(self, table: pa.Table):
        buf, off = flat(table.column("_text"))
        _, _, h, before = words(buf, off)
        self.n_words = np.diff(before)
        has = np.flatnonzero(self.n_words)
        m = self.n_words[has]
        seq = np.full(int(m.sum()) + ORDER * len(has), BEGIN, np.uint64)
        stop = np.cumsum(m + ORDER)
        seq[stop - 1] = END
        seq[np.arange(len(h)) + np.repeat(np.arange(len(has)) * ORDER + ORDER - 1, m)] = h
        told = np.ones(len(seq), bool)
        for i in range(ORDER - 1):
            told[stop - m - ORDER + i] = False
        self.at = np.flatnonzero(told)
        self.doc = np.repeat(has, m + 1)
        #: Where a text begins among the keys.
        self.first = np.cumsum(m + 1) - (m + 1)
        self.keys = []
        x = np.zeros(len(self.at), np.uint64)
        for k in range(ORDER):
            x = mix((x + seq[self.at - k]) * _GOLD + np.uint64(k))
            self.keys.append(x & _SIX)
        ids = table.column("_id").to_numpy()
        label = table.column("_label").to_numpy(zero_copy_only=False).astype(bool)
        self.target = np.isin(ids, ids[label]) & ~label & table.column("_named").to_numpy(zero_copy_only=False).astype(bool)
        self.label = label


def _parts(keys: np.ndarray, blocks: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys: each bucket holds a range of hashes."""
    bucket = ((keys >> np.uint64(16)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    if not len(keys):
        return []
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return [(int(bucket[i]), int(i), int(j)) for i, j in zip(head, np.append(head[1:], len(keys)), strict=True)]


def _press(values: np.ndarray) -> bytes:
    return pa.compress(pack(values, 6), codec="zstd", asbytes=True)


def _opened(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    return unpack(pa.decompress(data, n * 6, codec="zstd", asbytes=True), kind, 6)


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums n and t of a bucket's n-grams of one length, and where in them each that came is."""
    many = table.column("many").to_pylist()
    keys, n, t = (np.concatenate([_opened(x, m, kind) for x, m in zip(table.column(c).to_pylist(), many, strict=True)]) for c, kind in (("h", np.uint64), ("n", np.int64), ("t", np.int64)))
    # Keys came as differences, from 0 in each block.
    at = np.cumsum(many) - many
    keys = np.cumsum(keys, dtype=np.uint64)
    keys -= np.repeat(np.where(at > 0, keys[at - 1], np.uint64(0)), many)
    # Each block's keys ascend: merging them is quick.
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.append(True, keys[1:] != keys[:-1])
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    return np.add.reduceat(n[order], first), np.add.reduceat(t[order], first), where


def _log_probs(g: Grams, left: list[np.ndarray], total: float, kinds: float) -> np.ndarray:
    """log probability of each word and end, from the counts of the n-grams that end there and of all words, both without the text's own."""
    n = len(g.at)
    # Every text has the contexts that reach before it once, as it has its end: their count is that of the ends.
    texts = left[0][np.append(g.first[1:], n) - 1]
    p = (left[0] + 1) / (total + kinds)
    for k in range(1, ORDER):
        context = np.append(0, left[k - 1][:-1])
        context[g.first] = texts
        p = (left[k] + MASS * p) / (context + MASS)
    return np.log(p)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, threshold: float = 0.0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores all documents: those labelled of good quality are the target, all documents the background.

    Result: the id, n_tokens (words), target_loss, background_loss (nats per word, the end counted as one), lm_score (their difference), kept."""
    blocks = max(1, -(-text_bytes(docs, text) // BLOCK))
    texts = docs.select(F.col(doc_id), id_key(doc_id).alias("_id"), text_or_empty(text).alias("_text"), F.lit(False).alias("_label"), F.col(doc_id).isNotNull().alias("_named"))
    good = labels.where("quality = 1 and doc_id is not null").select(
        F.lit(None).cast(docs.schema[doc_id].dataType).alias(doc_id), id_key("doc_id").alias("_id"), F.lit("").alias("_text"), F.lit(True).alias("_label"),
        F.lit(True).alias("_named")
    )
    unnamed = F.when(~F.col("_named"), F.col("_text"))
    base = dealt(texts.union(good).withColumn("_block", F.pmod(F.xxhash64("_id", unnamed), F.lit(blocks)).cast("int")))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        g = Grams(undealt(table))
        wanted = g.target[g.doc]
        out: dict[str, list] = {c: [] for c in ("bucket", "block", "k", "many", "h", "n", "t")}
        for k in range(ORDER):
            keys, n = np.unique(g.keys[k], return_counts=True)
            mine, many = np.unique(g.keys[k][wanted], return_counts=True)
            t = np.zeros(len(keys), np.int64)
            t[np.searchsorted(keys, mine)] = many
            for bucket, i, j in _parts(keys, blocks):
                row = bucket, key[0].as_py(), k, j - i, _press(np.diff(keys[i:j], prepend=np.uint64(0))), _press(n[i:j].astype(np.int64)), _press(t[i:j])
                for c, x in zip(out.values(), row, strict=True):
                    c.append(x)
        return pa.table(out, schema=pa.schema([*[(c, pa.int32()) for c in ("bucket", "block", "k", "many")], *[(c, pa.binary()) for c in "hnt"]]))

    def total(table: pa.Table) -> pa.Table:
        table = table.filter(pc.equal(table.column("k"), 0))
        n, t, _ = _summed(table) if table.num_rows else [np.zeros(0, np.int64)] * 3
        return pa.table({"kinds": [len(n)], "all_n": [int(n.sum())], "all_t": [int(t.sum())]})

    def back(table: pa.Table) -> pa.Table:
        out = []
        for k in range(ORDER):
            part = table.filter(pc.equal(table.column("k"), k))
            if part.num_rows:
                n, t, where = _summed(part)
                cells = np.split(where, np.cumsum(part.column("many").to_numpy())[:-1])
                out.append(
                    pa.table(
                        {
                            "_block": part.column("block"), "bucket": part.column("bucket"), "k": part.column("k"),
                            "n": pa.array([_press(n[c]) for c in cells], pa.binary()), "t": pa.array([_press(t[c]) for c in cells], pa.binary())
                        }
                    )
                )
        return pa.concat_tables(out)

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = undealt(left)
        g = Grams(left)
        rows = left.num_rows
        loss = np.zeros((2, rows))
        if len(g.at):
            told = {(k, b): x for k, b, *x in zip(*(right.column(c).to_pylist() for c in ("k", "bucket", "n", "t")), strict=True)}
            counts: tuple[list, list] = ([], [])
            for k in range(ORDER):
                # Equal n-grams come together, those of one text too.
                order = np.argsort(g.keys[k], kind="stable")
                keys, doc = g.keys[k][order], g.doc[order]
                new = np.append(True, keys[1:] != keys[:-1])
                first = np.flatnonzero(new | np.append(True, doc[1:] != doc[:-1]))
                many = np.diff(np.append(first, len(keys)))
                own = np.repeat(many, many)
                kind = np.cumsum(new) - 1
                sums = [np.concatenate(x) for x in zip(*([_opened(x, j - i) for x in told[k, b]] for b, i, j in _parts(keys[new], blocks)), strict=True)]
                for out, total_of, mine in zip(counts, reversed(sums), (g.target[doc], 1), strict=True):
                    at = np.empty(len(keys))
                    at[order] = total_of[kind] - own * mine
                    out.append(at)
            kinds, all_n, all_t = (right.column(c)[0].as_py() for c in ("kinds", "all_n", "all_t"))
            for i, (left_counts, size, mine) in enumerate(((counts[0], all_t, g.target[g.doc]), (counts[1], all_n, 1))):
                loss[i] = np.bincount(g.doc, -_log_probs(g, left_counts, size - (g.n_words[g.doc] + 1) * mine, kinds), rows) / (g.n_words + 1)
        none = g.n_words == 0
        diff = loss[0] - loss[1]
        out = pa.table({
            doc_id: left.column(doc_id), "n_tokens": pa.array(g.n_words.astype(np.int64)), "target_loss": pa.array(loss[0], mask=none), "background_loss": pa.array(loss[1], mask=none),
            "lm_score": pa.array(diff, mask=none), "kept": pa.array((diff <= threshold) & ~none),
        })
        return out.filter(pa.array(~g.label))

    from pyspark.sql.types import StructType

    result = StructType([docs.schema[doc_id], *StructType.fromDDL("n_tokens bigint, target_loss double, background_loss double, lm_score double, kept boolean").fields])
    sent = base.groupBy("_block").applyInArrow(send, "bucket int, block int, k int, many int, h binary, n binary, t binary")
    totals = sent.groupBy("bucket").applyInArrow(total, "kinds long, all_n long, all_t long").agg(*[F.sum(c).alias(c) for c in ("kinds", "all_n", "all_t")])
    told = sent.groupBy("bucket").applyInArrow(back, "_block int, bucket int, k int, n binary, t binary").crossJoin(F.broadcast(totals))
    return base.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(score, result)
