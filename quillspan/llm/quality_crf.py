"""Quality rules: lines are labelled content or boilerplate by Viterbi decoding of a linear-chain CRF; a document stays
if content lines hold enough of its words.

Line features are shares and counts from bytes and words, and whether the line is common in the corpus (see FEATURES). A line is
common if it occurs `at_least` times in all texts and not always between the same lines, as the lines of copied texts do; it
counts as such in texts of whose words common lines hold less than half, as others are copies with edits. Common lines are
counted over all documents, by sums that are taken before the shuffle.

The CRF is trained by maximum likelihood on at most `max_train` labelled documents, those with the least hash of their id, and of
each on at most `max_lines` consecutive lines. What is taken for boilerplate there: lines of documents of bad quality, and the common lines of good
ones, so that labels change inside texts. Lines are what newlines part; lines without a word have no label and no say.

Before the CRF come base rules on words ([^\\x20\\x09-\\x0D]+): fewer than `min_words` words, or more than half of the words
in windows of three words that occur twice or more in the text.

Null and empty texts have no words and fail the base rules. Repeated rows get equal results. Without labelled texts of both
kinds every line is content. An empty table gives an empty result. Input columns may have any name but `_quality`, which is replaced. No text is cut: counts, windows and labels cover it whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_np import flat, groups, inside_texts, mix, runs_of, words
from .common import WORD, cut, freed, id_key, packed, unpacked, wider

MAX_TRAIN, MAX_LINES = 4_000, 200
#: Common lines are broadcast up to so many, else joined by shuffle.
BROADCAST_LINES = 500_000
#: The seed of the JVM's xxhash64.
SEED = 42
FEATURES = ("bias", "upper", "lower", "digit", "symbol", "mark", "bang", "other", "long_words", "few_words", "repeated", "duplicate", "end", "first", "last", "lone_marks", "common")
COMMON = FEATURES.index("common")
SYMBOLS = b"#*$%&|<>"


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SYMBOL = _class(SYMBOLS)
#: Of each byte the place in FEATURES, from "upper" to "other", that counts it; 0: none.
KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), SYMBOLS, b".,;:?'\"()-", b"!", bytes(range(128, 256)))):
    KIND[list(_chars)] = _k + 1
IS_MARK = _class(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
IS_START = np.ones(256, bool)  # of a code point
IS_START[0x80:0xC0] = False


class Lines:
    """The base figures of a group of texts, and the features of their lines with a word."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, common: np.ndarray):
        """common: ascending hashes of common lines."""
        n = len(off) - 1
        starts, ends, h, before = words(buf, off)
        of_text = np.repeat(np.arange(n), np.diff(before))
        per = lambda v: np.bincount(of_text, v, minlength=n).astype(np.int64)
        so_far = np.append(0, np.cumsum(IS_START[buf], dtype=np.int64))
        self.n_words = np.diff(before)
        self.word_chars = per(so_far[ends] - so_far[starts])
        so_far = np.append(0, np.cumsum(IS_SYMBOL[buf], dtype=np.int64))
        self.n_symbols = so_far[off[1:]] - so_far[off[:-1]]
        # Windows of three words that occur again in their text.
        repeated = np.zeros(len(h), bool)
        at = np.flatnonzero(inside_texts(before, 3))
        tri = mix(runs_of(h, 3)[at] + of_text[at].astype(np.uint64))
        order = np.argsort(tri)
        same = tri[order][1:] == tri[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for i in range(3):
            repeated[at[order[twice]] + i] = True
        self.n_repeat_words = per(repeated)
        # Lines: where each begins, of those with a word.
        breaks = np.flatnonzero(buf == 10)
        line_at = np.unique(np.concatenate([off[:-1], breaks + 1]))
        of_line = np.searchsorted(line_at, starts, "right") - 1
        filled, first_word = np.unique(of_line, return_index=True)
        words_in = np.diff(np.append(first_word, len(starts)))
        self.begin = line_at[filled]
        after = np.append(line_at, off[-1])[filled + 1]
        self.end = after - ((after > self.begin) & (np.take(buf, after - 1, mode="clip") == 10)) if len(filled) else after
        self.text = np.searchsorted(off, self.begin, "right") - 1
        self.words = words_in
        m = len(filled)
        seen: dict[tuple[int, bytes], None] = {}
        again = np.zeros(m, bool)
        current = -1
        hashes = np.zeros(m, np.int64)
        for i, (t, a, b) in enumerate(zip(self.text.tolist(), self.begin.tolist(), self.end.tolist(), strict=True)):
            if t != current:
                current, seen = t, {}
            line = buf[a:b].tobytes()
            again[i] = line in seen
            seen[line] = None
            if len(common):
                x = xxhash.xxh64_intdigest(line, SEED)
                hashes[i] = x - (x >> 63 << 64)
        self.n_dup_lines = np.bincount(self.text, again, minlength=n).astype(np.int64)
        x = np.zeros((m, len(FEATURES)))
        if m:
            cells = np.maximum(np.add.reduceat(ends - starts, first_word), 1)
            x[:, 0] = 1
            edges = np.stack([self.begin, self.end], axis=1).ravel()
            kinds = np.bincount(
                np.repeat(
                    np.arange(2 * m) % 2 * m * 8 + np.arange(2 * m) // 2 * 8, np.diff(np.append(edges, self.end[-1]))
                ) + KIND[buf[edges[0] : self.end[-1]]],
                minlength=m * 8
            )[: m * 8]
            x[:, 1:8] = kinds.reshape(m, 8)[:, 1:] / cells[:, None]
            lone = (ends - starts == 1) & IS_MARK[buf[starts]]
            x[:, 15] = np.add.reduceat(lone.astype(float), first_word) / words_in
            x[:, 8] = np.minimum(cells / words_in / 20, 2)
            x[:, 9] = 1 / words_in
            x[:, 10] = np.add.reduceat(repeated.astype(float), first_word) / words_in
            x[:, 11] = again
            x[:, 12] = np.isin(buf[ends[first_word + words_in - 1] - 1], list(b".!?:"))
            x[:, 13] = np.append(True, self.text[1:] != self.text[:-1])
            x[:, 14] = np.append(self.text[1:] != self.text[:-1], True)
            if len(common):
                found = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
                few = 2 * np.bincount(self.text, words_in * found, minlength=n) < self.n_words
                x[:, COMMON] = found & few[self.text]
        self.x = x


class CRF:
    """Two labels, 0 content and 1 boilerplate: emission weights (features x 2) and transition scores (2 x 2)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, x: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best labels of the lines, text by text."""
        e = (x @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        n = len(e)
        back0, back1 = [False] * n, [False] * n
        t = text.tolist()
        out = [0] * n
        i = 0
        while i < n:
            j = i
            a, b = e[i]
            while j + 1 < n and t[j + 1] == t[i]:
                j += 1
                c, d = e[j]
                to0, to1 = b + m10 > a + m00, b + m11 > a + m01
                back0[j], back1[j] = to0, to1
                a, b = (b + m10 if to0 else a + m00) + c, (b + m11 if to1 else a + m01) + d
            label = 1 if b > a else 0
            for k in range(j, i - 1, -1):
                out[k] = label
                label = int(back1[k] if label else back0[k])
            i = j + 1
        return np.array(out, np.int8)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def minimize(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """The least of a smooth convex function of which `objective` gives the value and the gradient, by L-BFGS with backtracking."""
    value, g = objective(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, back = g.copy(), []
        for s, y, r in reversed(pairs):
            back.append(r * (s @ d))
            d -= back[-1] * y
        if pairs:
            s, y, r = pairs[-1]
            d /= r * (y @ y)
        for (s, y, r), x in zip(pairs, reversed(back), strict=True):
            d += s * (x - r * (y @ d))
        slope, rate = g @ d, 1.0 if pairs else 1.0 / max(1.0, np.abs(g).sum())
        while rate > 1e-10:
            new, at = objective(w - rate * d)
            if new <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = -rate * d, at - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))]
        done = value - new < 1e-8
        w, value, g = w + s, new, at
        if done:
            break
    return w


def fit_crf(x: np.ndarray, text: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 120) -> CRF:
    """Maximum likelihood by forward-backward and L-BFGS, all chains at once; chains are sorted by length, so step t works on those that reach t."""
    if not len(y) or y.min() == y.max():
        emit = np.zeros((x.shape[1], 2))
        emit[0, 0] = 1.0
        return CRF(emit, np.zeros((2, 2)))
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    length = np.diff(np.append(first, len(text)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    reach = [int((length > t).sum()) for t in range(int(length[0]))]
    gold = np.zeros((len(y), 2))
    gold[np.arange(len(y)), y] = 1
    joined = np.flatnonzero(text[1:] == text[:-1]) + 1
    gold_move = np.zeros((2, 2))
    np.add.at(gold_move, (y[joined - 1], y[joined]), 1)
    ascending = np.sort(first)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        emit, move = w[:-4].reshape(-1, 2), w[-4:].reshape(2, 2)
        e = x @ emit
        alpha, beta = e.copy(), np.zeros_like(e)
        for t in range(1, len(reach)):
            r = first[: reach[t]] + t
            alpha[r] = e[r] + _log_sum(alpha[r - 1][:, :, None] + move[None], 1)
        for t in range(len(reach) - 1, 0, -1):
            r = first[: reach[t]] + t
            beta[r - 1] = _log_sum(move[None] + (e[r] + beta[r])[:, None, :], 2)
        z = _log_sum(alpha[first + length - 1], 1)
        full = np.zeros(len(y))
        full[first] = z
        full = np.repeat(full[ascending], np.diff(np.append(ascending, len(y))))
        p = np.exp(alpha + beta - full[:, None])
        pair = np.exp(alpha[joined - 1][:, :, None] + move[None] + (e[joined] + beta[joined])[:, None, :] - full[joined][:, None, None]).sum(axis=0)
        value = (z.sum() - (e * gold).sum() - (move * gold_move).sum()) / len(y) + l2 / 2 * (w @ w)
        return float(value), np.concatenate([(x.T @ (p - gold) / len(y)).ravel(), ((pair - gold_move) / len(y)).ravel()]) + l2 * w

    w = minimize(objective, np.zeros(2 * x.shape[1] + 4), steps)
    return CRF(w[:-4].reshape(-1, 2), w[-4:].reshape(2, 2))


class Common:
    """The common lines' hashes: all in `hashes`, or in `table` (h) if they are too many to broadcast."""

    def __init__(self, hashes: np.ndarray, table: DataFrame | None = None):
        self.hashes, self.table = hashes, table

    def told(self, docs: DataFrame, text: Column) -> DataFrame:
        """`docs` (packed) with _common: the hashes of each text's common lines, if they come by rows."""
        if self.table is None:
            return docs.withColumn("_common", F.array().cast("array<bigint>"))
        keyed = docs.withColumn("_th", F.xxhash64(text))
        rows = keyed.select("_th", F.explode(F.array_distinct(F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x)))).alias("h")).distinct()
        lists = rows.join(self.table, "h").groupBy("_th").agg(F.collect_set("h").alias("_common"))
        return keyed.join(lists, "_th", "left").drop("_th").withColumn("_common", F.coalesce("_common", F.array().cast("array<bigint>")))


NO_LINES = Common(np.zeros(0, np.int64))


def common_lines(docs: DataFrame, at_least: int = 3, text: str = "text") -> Common:
    """Lines with a word that occur `at_least` times, and not always after the same line and before the same line."""
    lines = docs.select(F.split(text, "\n", -1).alias("l")).where(F.size("l") > 0)
    hashed = lines.select("l", F.transform("l", lambda x: F.xxhash64(x)).alias("h"))
    at = lambda i: F.coalesce(F.get("h", i), F.lit(0))
    rows = hashed.select(
        F.explode(
            F.transform(
                "l", lambda x, i: F.struct(F.get("h", i).alias("h"), at(i - 1).alias("before"), at(i + 1).alias("after"), x.rlike(WORD).alias("filled"))
            )
        ).alias("r")
    ).select("r.*").where("filled")
    sums = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("before", "after") for f in (F.min, F.max)])
    table = cut(sums.where((F.col("n") >= at_least) & ((F.col("min_before") != F.col("max_before")) | (F.col("min_after") != F.col("max_after")))).select("h"))
    if table.limit(BROADCAST_LINES + 1).count() > BROADCAST_LINES:
        return Common(np.zeros(0, np.int64), table)
    return Common(np.sort(table.toArrow().column("h").to_numpy()))


def _known(lists: pa.ListArray, hashes: np.ndarray) -> np.ndarray:
    """The common lines that a batch may hold: those broadcast, or those that its rows name."""
    rows = lists.flatten().to_numpy(zero_copy_only=False)
    return np.unique(rows) if len(rows) else hashes


def train_crf(docs: DataFrame, labels: DataFrame, common: Common = NO_LINES, max_train: int = MAX_TRAIN, max_lines: int = MAX_LINES) -> CRF:
    """Fits the CRF on a bounded sample of labelled documents; the driver gets the features of max_train * max_lines lines at most."""
    sample = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_l")).agg(F.min("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("_l"), "_l").limit(max_train)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_l")).select(
        F.struct(
            F.col("quality").cast("int").alias("quality"), id_key("doc_id").alias("id"), "text"
        ).alias("row")
    )
    hashes = docs.sparkSession.sparkContext.broadcast(common.hashes)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("row")
            buf, off = flat(rows.field("text"))
            known = _known(b.column("_common"), hashes.value)
            out = []
            for i, doc in enumerate(rows.field("id").to_pylist()):
                x = Lines(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), known).x.astype(np.float32)
                at = xxhash.xxh64_intdigest(str(doc), SEED) % max(1, len(x) - max_lines + 1)
                out.append(x[at : at + max_lines].tobytes())
            yield pa.RecordBatch.from_arrays([rows.field("quality"), pa.array(out, pa.binary())], ["quality", "x"])

    got = common.told(picked, F.col("row.text")).mapInArrow(freed(features), "quality int, x binary").toArrow()
    pairs = sorted(zip(got.column("quality").to_pylist(), got.column("x").to_pylist(), strict=True), key=lambda p: (p[1], p[0]))
    xs = [np.frombuffer(b, np.float32).reshape(-1, len(FEATURES)) for _, b in pairs]
    if not xs or not sum(map(len, xs)):
        return fit_crf(np.zeros((0, len(FEATURES))), np.zeros(0, int), np.zeros(0, int))
    x, n = np.concatenate(xs).astype(float), [len(x) for x in xs]
    bad = np.repeat([not q for q, _ in pairs], n)
    if bad.all() or not bad.any():
        return fit_crf(np.zeros((0, len(FEATURES))), np.zeros(0, int), np.zeros(0, int))
    return fit_crf(x, np.repeat(np.arange(len(xs)), n), (bad | (x[:, COMMON] > 0)).astype(int))


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(docs: DataFrame, crf: CRF, common: Common = NO_LINES, min_words: int = 50, min_content: float = 0.5, text: str = "text") -> DataFrame:
    """Adds a struct _quality: the base figures, base_failed, the number of labelled lines, content words, content_share,
    kept, and the labels (array<tinyint>, one for each line with a word; 0 content, 1 boilerplate)."""
    model = docs.sparkSession.sparkContext.broadcast((crf, common.hashes))
    kind = pa.struct(
        [
            *((f, pa.int64()) for f in _FIELDS), ("base_failed", pa.bool_()), ("n_lines", pa.int64()), ("content_words", pa.int64()),
            ("content_share", pa.float64()), ("kept", pa.bool_()), ("labels", pa.list_(pa.int8()))
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, hashes = model.value
        for b in batches:
            buf, off = flat(b.column(0).field(text))
            known = _known(b.column(1), hashes)
            parts = []
            for i, j in groups(off):
                g = Lines(buf[off[i] : off[j]], off[i : j + 1] - off[i], known)
                n = j - i
                label = crf.decode(g.x, g.text)
                lines = np.bincount(g.text, minlength=n)
                content = np.bincount(g.text, g.words * (label == 0), minlength=n).astype(np.int64)
                share = content / np.maximum(g.n_words, 1)
                failed = (g.n_words < min_words) | (100 * g.n_repeat_words > 50 * g.n_words)
                labels = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lines)).astype(np.int32)), pa.array(label))
                cols = [pa.array(getattr(g, f).astype(np.int64)) for f in _FIELDS] + [
                    pa.array(failed), pa.array(lines.astype(np.int64)), pa.array(content), pa.array(share), pa.array(~failed & (share >= min_content)), labels
                ]
                parts.append(pa.StructArray.from_arrays(cols, fields=list(kind)))
            out = pa.concat_arrays(parts) if parts else pa.array([], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["row", "_quality"])

    ddl = ", ".join([*(f"{f}: bigint" for f in _FIELDS), "base_failed: boolean, n_lines: bigint, content_words: bigint, content_share: double, kept: boolean, labels: array<tinyint>"])
    return unpacked(common.told(packed(docs), F.col("row").getField(text)).mapInArrow(freed(run), wider(docs, f"_quality struct<{ddl}>")), docs.columns, "_quality")
