"""Toxicity by a classifier chain.

The categories are predicted in a fixed order by logistic models over the same word features; each later model also gets
the earlier categories' probabilities, and is trained with out-of-fold ones, so that it meets them in training as they will be
when applied. The last category is the label itself. The labels tell no kinds of toxicity, so the categories before it come from
the data: the toxic training texts are parted into `kinds` clusters by the features that they have more often than others
(spherical k-means, without chance), the largest first; a text is of a kind if it is toxic and in that cluster.

Features: which of the `n_features` words and word beginnings of PREFIX bytes (hashed, ASCII case folded, ASCII punctuation
around them ignored) that tell toxic from other training texts best occur in the text. Beginnings find inflected forms. Trained on at most `max_train` labelled documents, those with the least hash of their id; applied to all texts whole.

A document is rejected from the probability that at most `max_false` of the other training texts reach out of fold, within THRESHOLDS.

Null and empty texts have no features and get the models' base rates. Repeated rows get equal results. A document is
labelled by the largest of its labels; without a toxic and a non-toxic training text all probabilities are 0 and nothing is rejected.
An empty table gives an empty result. Input columns may have any name but `_toxicity`, which is replaced. Texts are read in groups of bounded size, a very long one by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import flat, groups, mix, words
from .common import freed, packed, unpacked, wider

#: Clusters of toxic texts that are categories before the label.
KINDS = 2
#: The bounds of the probability from which a document is rejected, and the share of other texts that may reach it.
THRESHOLDS, MAX_FALSE = (0.1, 0.5), 0.001
MAX_TRAIN = 20_000
PREFIX = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII that isn't a letter or digit parts words here, so that "idiot," is "idiot".
_LOWER[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of groups of texts: the number of the first one, the features of all words, and where each text's begin."""
    buf, off = flat(texts)
    for i, j in groups(off):
        part = _LOWER[buf[off[i] : off[j]]]
        starts, ends, h, before = words(part, off[i : j + 1] - off[i])
        begin = np.full(len(h), 7, np.uint64)
        for at in range(PREFIX):
            inside = starts + at < ends
            begin = mix(begin + np.where(inside, part[np.minimum(starts + at, ends - 1)], 0))
        yield i, np.stack([h, np.where(ends - starts > PREFIX, begin, h)], axis=1).ravel(), before * 2


def word_ids(texts: pa.Array) -> list[np.ndarray]:
    """Per text its distinct features, sorted."""
    return [np.unique(h[a:b]) for _, h, before in hashed_words(texts) for a, b in zip(before[:-1], before[1:], strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: how many texts, and how many toxic ones, have each feature."""
    for b in batches:
        ids = word_ids(b.column("text"))
        if ids:
            toxic = np.repeat(b.column("toxic").to_numpy(zero_copy_only=False).astype(float), [len(x) for x in ids])
            kinds, where = np.unique(np.concatenate(ids), return_inverse=True)
            cols = [kinds.view(np.int64), np.bincount(where, minlength=len(kinds)), np.bincount(where, toxic, minlength=len(kinds)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["feature", "n", "pos"])


def telling(pos: np.ndarray, n: np.ndarray, toxic: float, total: float) -> np.ndarray:
    """Two-proportion z: how far more or less often features occur in toxic texts than in others."""
    p1, p0 = (pos + 0.5) / (toxic + 1), (n - pos + 0.5) / (total - toxic + 1)
    pool = (n + 1) / (total + 2)
    return np.abs(p1 - p0) / np.sqrt(pool * (1 - pool) * (1 / toxic + 1 / (total - toxic)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 30, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the bias, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """Models of the categories in order; model k has the words' features and k probabilities."""

    def __init__(self, names: Sequence[str], vocabulary: np.ndarray, models: list[np.ndarray], threshold: float = THRESHOLDS[1]):
        self.names, self.vocabulary, self.models, self.threshold = list(names), vocabulary, models, threshold

    def features(self, ids: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(ids), len(self.vocabulary)))
        if len(self.vocabulary):
            for i, h in enumerate(ids):
                at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
                x[i, at[self.vocabulary[at] == h]] = 1
        return x

    def apply(self, texts: pa.Array) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)))
        for i, h, before in hashed_words(texts):
            if len(self.vocabulary):
                at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
                hit = np.flatnonzero(self.vocabulary[at] == h)
                x[i + np.searchsorted(before, hit, "right") - 1, at[hit]] = 1
        for w in self.models:
            x = np.hstack([x, predict(x, w)[:, None]])
        return x[:, len(self.vocabulary) :]


def out_of_fold(x: np.ndarray, y: np.ndarray, folds: int, whole: np.ndarray) -> np.ndarray:
    """Each row's probability by a model of the rows of other folds; row i is in fold i % folds. The fits start from the weights `whole`."""
    out, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        train = fold != k
        out[~train] = predict(x[~train], fit_logistic(x[train], y[train], start=whole))
    return out


def clusters(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """The cluster of each row, 0 the largest, by spherical k-means from equal parts of the rows along their first principal axis."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    axis = np.linalg.eigh(np.cov(unit.T) if len(unit) > 1 else np.eye(unit.shape[1]))[1][:, -1]
    own = np.argsort(np.argsort(unit @ axis, kind="stable"), kind="stable") * k // max(1, len(unit))
    for _ in range(rounds):
        c = np.stack([unit[own == j].sum(axis=0) for j in range(k)])
        own = (unit @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).T).argmax(axis=1)
    return np.argsort(np.argsort(-np.bincount(own, minlength=k), kind="stable"), kind="stable")[own]


def fit_chain(ids: list[np.ndarray], toxic: np.ndarray, kinds: int = KINDS, n_features: int = 256, folds: int = 5, vocabulary: np.ndarray | None = None, max_false: float = MAX_FALSE) -> Chain:
    """Fits the models; the features are `vocabulary`, or else the `n_features` that tell most of these texts."""
    names = [*(f"kind_{k + 1}" for k in range(kinds)), "toxic"]
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return Chain(names, np.zeros(0, np.uint64), [np.array([*[0.0] * k, -30.0]) for k in range(len(names))])
    if vocabulary is None:
        distinct, where = np.unique(np.concatenate(ids), return_inverse=True)
        z = telling(np.bincount(where, np.repeat(y, [len(x) for x in ids])), np.bincount(where), y.sum(), len(y))
        vocabulary = distinct[np.argsort(-z, kind="stable")[:n_features]]
    chain = Chain(names, np.sort(vocabulary), [])
    x = chain.features(ids)
    bad = y > 0
    more = x[bad].mean(axis=0) > x[~bad].mean(axis=0)
    of = clusters(x[bad][:, more], kinds)
    labels = []
    for k in range(kinds):
        labels.append(np.zeros(len(y)))
        labels[-1][np.flatnonzero(bad)[of == k]] = 1
    for label in [*labels, y]:
        chain.models.append(fit_logistic(x, label))
        last = out_of_fold(x, label, folds, chain.models[-1])
        x = np.hstack([x, last[:, None]])
    others = np.sort(last[~bad])
    reach = others[max(0, len(others) - 1 - int(max_false * len(others)))]
    chain.threshold = float(np.clip(np.nextafter(reach, 1), *THRESHOLDS))
    return chain


def train_chain(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, n_features: int = 256, **how) -> Chain:
    """Fits the chain on a bounded sample: at most `max_train` ids are broadcast.

    Features are counted and ranked on the executors; of each text the driver gets only those of the `n_features` chosen that it has.
    """
    sample = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_l")).agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("_l"), "_l").limit(max_train)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_l")).select(F.col("toxic").cast("int").alias("toxic"), "text")
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos")).first()
    if not size["n"] or size["pos"] in (0, size["n"]):
        return fit_chain([], np.zeros(0), **how)
    total, pos = float(size["n"]), float(size["pos"])
    counts = texts.mapInArrow(freed(_count), "feature long, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    p1, p0, pool = (F.col("pos") + 0.5) / (pos + 1), (F.col("n") - F.col("pos") + 0.5) / (total - pos + 1), (F.col("n") + 1) / (total + 2)
    z = F.abs(p1 - p0) / F.sqrt(pool * (1 - pool) * (1 / pos + 1 / (total - pos)))
    chosen = counts.select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(n_features).toArrow()
    vocabulary = np.sort(chosen.column("feature").to_numpy().astype(np.int64).view(np.uint64))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array([np.intersect1d(x, vocabulary, assume_unique=True).tobytes() for x in word_ids(b.column("text"))], pa.binary())],
                ["toxic", "ids"]
            )

    got = texts.mapInArrow(freed(gather), "toxic int, ids binary").toArrow()
    pairs = sorted(zip(got.column("toxic").to_pylist(), got.column("ids").to_pylist(), strict=True), key=lambda p: (p[1], p[0]))
    return fit_chain([np.frombuffer(b, np.uint64) for _, b in pairs], np.array([t for t, _ in pairs]), n_features=n_features, vocabulary=vocabulary, **how)


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float | None = None, text: str = "text") -> DataFrame:
    """Adds a struct _toxicity: p_<category> for each category and rejected, from the threshold given or the chain's own."""
    threshold = chain.threshold if threshold is None else threshold
    model = docs.sparkSession.sparkContext.broadcast(chain)
    fields = [f"p_{n}" for n in chain.names]
    kind = pa.struct([*((f, pa.float64()) for f in fields), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (big.slice(i, 2000) for big in batches for i in range(0, big.num_rows, 2000)):
            p = model.value.apply(b.column(0).field(text))
            cols = [pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(fields))] + [pa.array(p[:, -1] >= threshold)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(cols, fields=list(kind))], ["row", "_toxicity"])

    ddl = ", ".join([*(f"{f}: double" for f in fields), "rejected: boolean"])
    return unpacked(packed(docs).mapInArrow(freed(run), wider(docs, f"_toxicity struct<{ddl}>")), docs.columns, "_toxicity")
