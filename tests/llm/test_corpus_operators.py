"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.llm import bpe, bwt_dedup, jaccard_join, line_dedup, lm_words, merkle, mixing, quality_crf, shared_windows, suffix_trees, toxicity
from quillspan.llm.bytes_np import flat, mix, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(11)
VOCABULARY = ["the", "of", "Straße", "日本", "mñ", "and", "x" * 30, "ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr"]


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(VOCABULARY) + r.choice([" ", " ", " ", "\n", ". ", "\t"]) for _ in range(n))


BASE = prose(300, 1)
EDGES = [None, "", " \n\t ", "one", "a b c d", "é" * 60, "z" * 3000, "a b " * 400]


def corpus():
    """Documents with copies, near copies, shared passages, edge cases and repeated rows; the null id is a document too."""
    texts = list(EDGES) + [prose(n, n) for n in (5, 14, 60, 200, 500)]
    texts += [BASE, BASE, BASE + " end", BASE.replace("the", "thy", 1), prose(50, 7) + BASE[200:600] + prose(50, 8), BASE[100:500], prose(40, 9) + BASE[150:420]]
    rows = [(i * 3 % 41, t) for i, t in enumerate(texts)]
    return [*rows, (None, BASE), rows[-1], (rows[3][0], rows[3][1])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{(i or 0) % 4}" if (i or 0) % 5 else None, "keep") for i, t in corpus()]
    # Extra columns with names that the operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _id string").withColumns({"_th": F.lit(1), "_text": F.lit("t"), "row": F.lit("r"), "n": F.lit(2), "_block": F.lit(0), "size": F.lit(0), "ids": F.lit(0), "_copies": F.lit(9)}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def key(i):
    return -(2**63) if i is None else i


def test_words():
    texts = ["a bb  ccc", None, "", "dd\n\x0bé x", "zz", " nb"]
    buf, off = flat(pa.array(texts))
    starts, ends, h, before = words(buf, off)
    assert [bytes(buf[a:b]).decode() for a, b in zip(starts, ends)] == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(before).tolist() == [len(WORD.findall(t or "")) for t in texts]


def figures(t):
    t = t or ""
    w = WORD.findall(t)
    tri = defaultdict(list)
    for i in range(len(w) - 2):
        tri[tuple(w[i : i + 3])].append(i)
    again = {i + d for v in tri.values() if len(v) > 1 for i in v for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again)


def test_quality(spark, docs, empty):
    crf = quality_crf.CRF(np.zeros((len(quality_crf.FEATURES), 2)), np.zeros((2, 2)))
    out = quality_crf.judge_quality(docs, crf)
    assert out.columns == [*docs.columns, "_quality"]
    for r in out.collect():
        q = r._quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == figures(r.text)
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
        assert q.kept == (not q.base_failed) and r._id == "keep"
    assert quality_crf.judge_quality(empty, crf).count() == 0
    none = quality_crf.train_crf(docs, spark.createDataFrame([(3, None, None)], "doc_id long, quality int, toxic int"))
    assert quality_crf.judge_quality(docs, none).where("_quality.kept").count() == out.where("_quality.kept").count()


def test_crf_is_exact():
    """Decoding against all labelings, and gradients' direction by held-out accuracy."""
    rng = np.random.default_rng(2)
    crf = quality_crf.CRF(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    for n in (1, 2, 6):
        x = rng.normal(size=(n, 3))
        e = x @ crf.emit
        best = max(range(2**n), key=lambda m: sum(e[i, m >> i & 1] for i in range(n)) + sum(crf.move[m >> i & 1, m >> i + 1 & 1] for i in range(n - 1)))
        assert crf.decode(x, np.zeros(n, int)).tolist() == [best >> i & 1 for i in range(n)]
    y = np.repeat(rng.integers(0, 2, 120), 5)
    x = np.stack([np.ones(600), y * 2 - 1 + rng.normal(size=600) * 1.5, rng.normal(size=600)], axis=1)
    text = np.repeat(np.arange(60), 10)
    fitted = quality_crf.fit_crf(x[:400], text[:400], y[:400])
    alone = ((x[400:, 1] > 0) == y[400:]).mean()
    assert (fitted.decode(x[400:], text[400:]) == y[400:]).mean() > alone + 0.05  # the chain knows more than a line alone


def test_minimize():
    a = np.array([[3.0, 1.0], [1.0, 2.0]])
    got = quality_crf.minimize(lambda w: (float(0.5 * w @ a @ w - w.sum()), a @ w - 1), np.zeros(2), 50)
    assert got == pytest.approx(np.linalg.solve(a, np.ones(2)), abs=1e-3)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    t, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    common = quality_crf.common_lines(t)
    crf = quality_crf.train_crf(t, labels.where("doc_id % 2 = 0"), common)
    rows = quality_crf.judge_quality(t.join(labels.where("doc_id % 2 = 1"), "doc_id"), crf, common).select("quality", "_quality.kept", "_quality.base_failed").collect()
    bad = [r for r in rows if not r.quality]
    good = [r for r in rows if r.quality and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad) and sum(r.kept for r in good) >= 0.97 * len(good)
    shares = [r.s for r in quality_crf.judge_quality(t, crf, common).select(F.col("_quality.content_share").alias("s")).collect()]
    assert sum(0 < x < 1 for x in shares) > 0.2 * len(shares)


def test_common_lines(spark, monkeypatch):
    """Lines between others than always the same ones; copied texts have none, and texts made of such lines keep their labels."""
    copied = "\n".join(prose(12, 700 + k).replace("\n", " ") for k in range(5))
    rows = [(k, f"{prose(20, 80 + k)}\nmenu home\n{prose(30, 90 + k)}\nall rights reserved") for k in range(6)] + [(10 + k, copied) for k in range(5)] + [(20, "menu home\nall rights reserved\nab cd"), (21, None), (22, "")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    lines = Counter()
    beside = defaultdict(set)
    for _, x in rows:
        ls = (x or "").split("\n")
        for i, line in enumerate(ls):
            if WORD.search(line):
                lines[line] += 1
                beside[line, 0].add(ls[i - 1] if i else None)
                beside[line, 1].add(ls[i + 1] if i + 1 < len(ls) else None)
    want = {x for x, n in lines.items() if n >= 3 and (len(beside[x, 0]) > 1 or len(beside[x, 1]) > 1)}
    assert {"menu home", "all rights reserved"} <= want and not want & set(copied.split("\n"))
    hashes = {r.h: r.line for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.xxhash64("line").alias("h")).collect()}
    common = quality_crf.common_lines(t)
    assert {hashes[h] for h in common.hashes.tolist()} == want
    emit = np.zeros((len(quality_crf.FEATURES), 2))
    emit[0, 0], emit[quality_crf.COMMON, 1] = 1.0, 5.0
    crf = quality_crf.CRF(emit, np.zeros((2, 2)))
    judge = lambda c: Counter((r.doc_id, tuple(r.labels), round(r.share, 9)) for r in quality_crf.judge_quality(t, crf, c).select("doc_id", "_quality.labels", F.col("_quality.content_share").alias("share")).collect())
    got = judge(common)
    for (i, labels, share) in got:
        ls = [x for x in (dict(rows)[i] or "").split("\n") if WORD.search(x)]
        n = [len(WORD.findall(x)) for x in ls]
        minority = 2 * sum(k for x, k in zip(ls, n) if x in want) < sum(n)
        assert labels == tuple(int(x in want and minority) for x in ls)
        assert share == pytest.approx(sum(k for x, k in zip(labels, n) if not x) / max(1, sum(n)))
    assert all(0 < share < 1 for i, _, share in got if i < 6) and all(share == 1 for i, _, share in got if 10 <= i <= 20)
    monkeypatch.setattr(quality_crf, "BROADCAST_LINES", 0)
    by_rows = quality_crf.common_lines(t)
    assert by_rows.table is not None and judge(by_rows) == got
    assert len(quality_crf.common_lines(t.limit(0)).hashes) == 0


def removed_by_brute(rows, items, n):
    first = {}
    for i, t in rows:
        s = items(t)
        for k in range(len(s) - n + 1):
            w = s[k : k + n] if isinstance(s, bytes) else tuple(s[k : k + n])
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        s = items(t)
        gone = [False] * len(s)
        for k in range(len(s) - n + 1):
            if first[s[k : k + n] if isinstance(s, bytes) else tuple(s[k : k + n])] < key(i):
                gone[k : k + n] = [True] * n
        out.append((i, gone, [x for x, g in zip(s, gone) if not g]))
    return out


@pytest.mark.parametrize("block, hot", [(3000, 50), (3000, 2), (2000, 4), (10_000_000, 1)])
def test_substring_dedup(docs, empty, monkeypatch, block, hot):
    monkeypatch.setattr(shared_windows, "BLOCK", block)
    monkeypatch.setattr(shared_windows, "HOT", hot)
    spans = lambda g: [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[x] for x in g))]
    as_bytes = lambda t: (t or "").encode()
    as_words = lambda t: WORD.findall(t or "")
    want = Counter((i, len(g), sum(g), tuple(spans(g)), bytes(k)) for i, g, k in removed_by_brute(corpus(), as_bytes, 50))
    got = bwt_dedup.remove_repeated_bytes(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == want
    want = Counter((i, len(g), sum(g), tuple(spans(g)), " ".join(k).encode()) for i, g, k in removed_by_brute(corpus(), as_words, 13))
    got = suffix_trees.remove_repeated_words(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == want
    assert bwt_dedup.remove_repeated_bytes(empty).count() == suffix_trees.remove_repeated_words(empty).count() == 0


@pytest.mark.parametrize("alphabet, length", [("ab", 20), ("abcdefgh", 50)])
def test_matchers(alphabet, length):
    r = random.Random(4)
    base = ["".join(r.choice(alphabet) for _ in range(80)) for _ in range(4)]
    contexts = []
    for _ in range(40):
        c = list(r.choice(base)[(k := r.randint(0, 20)) : k + r.randint(length + 3, length + 9)])
        if r.random() < 0.5:
            c[r.randrange(len(c))] = "z"
        contexts.append("".join(c).encode())
    contexts = list(dict.fromkeys(contexts))
    ids = np.array([r.randint(0, 9) for _ in contexts])
    first = {}
    for c, i in zip(contexts, ids):
        for k in range(len(c) - length + 1):
            first[c[k : k + length]] = min(first.get(c[k : k + length], 99), i)
    want = {(x, k) for x, (c, i) in enumerate(zip(contexts, ids)) for k in range(len(c) - length + 1) if first[c[k : k + length]] < i}
    spread = lambda found: {(x, k) for x, a, n in found for k in range(a, a + n)}
    assert spread(bwt_dedup.match_contexts(contexts, ids, length)) == want
    spaced = [" ".join(c.decode()).encode() for c in contexts]
    for most in (5, 60, 100_000):
        assert spread(suffix_trees.match_contexts(spaced, ids, length, most)) == want


def test_common_prefixes_by_transform():
    """The bounds below each length against common prefixes counted one by one."""
    r = random.Random(8)
    s = np.array([0 if r.random() < 0.05 else r.randint(1, 3) for _ in range(400)] + [0], np.uint16)
    order = bwt_dedup.sort_suffixes(s, 60)
    for length in (1, 3, 8):
        got = bwt_dedup.bounds_below(s, order, length)
        for i in range(1, len(s)):
            a, b = s[order[i - 1] :].tolist(), s[order[i] :].tolist()
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k] or a[k] == 0), min(len(a), len(b)))
            if n < length and not (n < len(a) and n < len(b) and a[n] == b[n] == 0):
                assert got[i]
            elif n >= length:
                assert not got[i]


def test_deep_nodes():
    common = np.array([0, 3, 5, 5, 2, 4, 0, 3])
    assert sorted(suffix_trees.deep_nodes(common, 3)) == [(0, 4, 3), (1, 4, 5), (4, 6, 4), (6, 8, 3)]


def pieces(t):
    return re.split(r"(?<=\n)|(?<=[.!?] )", t) if t else [""]


def test_merkle(spark, docs, empty):
    out = merkle.compare_edited(docs)
    rows = sorted(set(corpus()), key=lambda x: (-key(x[0])))
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(corpus())
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        for r in got[i]:
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
            a, b, c = set(pieces(t)), set(pieces(edited)), set(pieces(following))
            assert r.near_edited == pytest.approx(2 * len(a & b) / (len(a) + len(b)) if t != edited else 1)
            assert r.near_next == pytest.approx(2 * len(a & c) / (len(a) + len(c)) if t != following else 1)
            x, y = pieces(t), pieces(edited)
            assert r.edit_paragraph == next((p for p in range(max(len(x), len(y))) if x[p : p + 1] != y[p : p + 1]), None)
    by_text = defaultdict(set)
    for i, t in corpus():
        by_text[t or ""] |= {r.fingerprint for r in got[i]}
    assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    assert merkle.compare_edited(empty).count() == 0


def test_merkle_long_lines(spark):
    """Long texts of one line have short leaves, in scripts without spaces too, and edits are found within the line."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (300, 2000)] + [",".join(word() for _ in range(900)), "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(4000)), "".join(chr(0x4E00 + r.randrange(3000)) + "。" * (k % 9 == 8) for k in range(150)), " ".join(chr(0x430 + r.randrange(32)) * r.randint(1, 4) + chr(0x430 + r.randrange(32)) for _ in range(600))]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x for x in merkle.compare_edited(t).collect()}
    for i, text in enumerate(texts):
        x = out[i]
        assert 0.4 < x.near_edited < 0.95 and x.near_next < 0.1
        assert x.n_leaves > len(text) / merkle.LONG and 0.45 < x.edit_leaf / x.n_leaves < 0.85
    runs = spark.createDataFrame([(k, "".join(f"{w} " * 60 for w in ws)) for k, ws in enumerate(("uno dos tres cuatro cinco".split(), "six seven eight".split()))], "doc_id long, text string")
    assert all(x.near_edited > 0.3 and x.edit_leaf > 0 for x in merkle.compare_edited(runs).collect())
    tree = merkle.with_tree(t.withColumn("pieces", merkle.shorter(F.col("text"))), "text", "o_").collect()
    assert all("".join(x.pieces) == x.text for x in tree)
    assert max(len(p) for x in tree for p in x.pieces) < 800


def test_line_dedup(spark, docs, empty):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nb\nc\nd"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (None, "b\nc\nd"), (2, "x\na\nb\nc\nb\nc\nd")]
    t = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit("keep"), "_starts": F.lit(1), "l": F.lit(2)})
    windows = {}
    for i, x in sorted(set(rows), key=lambda r: key(r[0])):
        ls = (x or "").split("\n")
        for p in range(len(ls) - 2):
            windows.setdefault(tuple(ls[p : p + 3]), (key(i), p))
    out = line_dedup.dedup_lines(t)
    assert out.columns == [*t.columns, "_lines"]
    for r in out.collect():
        x = dict((key(i), x) for i, x in rows)[key(r.doc_id)]
        ls = (x or "").split("\n")
        gone = {p + d for p in range(len(ls) - 2) if windows[tuple(ls[p : p + 3])] != (key(r.doc_id), p) for d in range(3)}
        assert r.text == (x if not gone else "\n".join(v for k, v in enumerate(ls) if k not in gone))
        assert (r._lines.n_lines, r._lines.n_removed, r._id) == (len(ls), len(gone), "keep")
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_lines(docs).count() == docs.count()


def test_bpe(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    alphabet = [*"abcdeth nsAB 12'.,!\n\t", "é", "ß", "日", "🙂", "👨‍👩‍👧", " ", "½", "́", "<|endoftext|>"]
    newer = ["'" + chr(0x319AC), chr(0x2EDF4) * 3, "a" + chr(0x1E4D0) + "'s", chr(0x11F50) + " 7", "n" + chr(0x10EFD)]
    texts = [t for _, t in corpus()] + newer + ["é" * 200_000, "ab" * 30_000 + " 🙂" * 50, " " * 5000 + "x", "1" * 999] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(300)]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumns({"ids": F.lit("old"), "pieces": F.lit(1), "row": F.lit(2)})
    out = bpe.decode_ids(bpe.encode_texts(t, path, P.PATTERN, offsets=True), path).collect()
    assert len(out) == len(texts)
    for x in out:
        text = texts[x.k] or ""
        assert x.ids == exact.encode_ordinary(text) and bytes(x.decoded) == text.encode()
        assert len(x.offsets) == len(x.ids)
        for i, o in zip(x.ids, x.offsets):
            assert exact.decode_single_token_bytes(i) in text[o.start : o.end].encode()
    both = bpe.encode_texts(t, path, P.PATTERN, decoded=True).select("ids", "decoded").collect()
    assert all(bytes(x.decoded) == b"".join(map(exact.decode_single_token_bytes, x.ids)) for x in both)
    assert bpe.encode_texts(empty, path, P.PATTERN, decoded=True).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode_ids(spark.createDataFrame([([999_999],)], "ids array<int>"), path).collect()


def test_lm_words(spark, docs, empty, monkeypatch):
    """Against dictionaries of all words: the text's own counts are left out, and the tables grow with the words."""
    monkeypatch.setattr(lm_words, "BLOCK", 3000)
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (21, 1, 0), (24, 1, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    good, counts = {3, 21, 24}, {True: Counter(), False: Counter()}

    def grams(t):
        s = ["<", "<", *WORD.findall(t or ""), ">"]
        return Counter(tuple(s[i - k : i + 1]) for i in range(2, len(s)) for k in range(3)) + Counter({("<",): 1, ("<", "<"): 1}) if len(s) > 3 else Counter()

    for i, t in corpus():
        counts[False] += grams(t)
        if i in good:
            counts[True] += grams(t)
    kinds = sum(len(g) == 1 and g != ("<",) for g in counts[False])
    want = Counter()
    for i, t in corpus():
        s = ["<", "<", *WORD.findall(t or ""), ">"]
        loss = []
        for target in (True, False):
            c = counts[target] - (grams(t) if i in good or not target else Counter())
            total = sum(n for g, n in c.items() if len(g) == 1 and g != ("<",))
            lost = 0
            for x in range(2, len(s)):
                p = (c[s[x],] + 1) / (total + kinds)
                for k in (1, 2):
                    p = (c[tuple(s[x - k : x + 1])] + 4 * p) / (c[tuple(s[x - k : x])] + 4)
                lost -= np.log(p)
            loss.append(round(lost / (len(s) - 2), 6) if len(s) > 3 else None)
        want[i, len(s) - 3, *loss] += 1
    out = lm_words.cross_entropy_difference(docs, labels).collect()
    some = lambda x: None if x is None else round(x, 6)
    assert Counter((r.doc_id, r.n_tokens, some(r.target_loss), some(r.background_loss)) for r in out) == want
    assert all(r.kept == (r.lm_score is not None and r.lm_score <= 0) for r in out)
    assert lm_words.cross_entropy_difference(empty, labels).count() == 0


def test_lm_query_tells_words_apart(spark, tmp_path):
    """Texts of letters that fold together under a byte's remainder are not alike."""
    rows = [(k, " ".join(chr(0x400 + (k % 2) * 10 + j) for j in range(9)) + f" {k}") for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1 - k % 2) for k in range(4)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    from quillspan.llm import queries

    got = {r.doc_id: r.lm_score for r in queries.op7_cross_entropy(spark, str(tmp_path)).collect()}
    assert max(got[k] for k in range(0, 12, 2)) + 1 < min(got[k] for k in range(1, 12, 2))


def test_toxicity(spark, docs, empty):
    d = "/root/testdata/sf0.1"
    t, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    chain = toxicity.train_chain(t, labels.where("doc_id % 2 = 0"))
    rows = toxicity.score_toxicity(t.join(labels.where("doc_id % 2 = 1"), "doc_id"), chain).select("toxic", "_toxicity.*").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.rejected for r in toxic) >= 0.85 * len(toxic) and sum(r.rejected for r in clean) <= 0.005 * len(clean)
    out = toxicity.score_toxicity(docs, chain)
    assert out.columns == [*docs.columns, "_toxicity"] and out.where("_id = 'keep' and not _toxicity.rejected").count() == len(corpus())
    assert toxicity.score_toxicity(empty, chain).count() == 0
    nobody = toxicity.train_chain(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, nobody).where("_toxicity.rejected").count() == 0


def chain_sample():
    r = np.random.default_rng(3)
    ids = [np.unique(r.integers(0, 50, 8).astype(np.uint64)) for _ in range(300)]
    return ids, np.array([int((3 in x or 7 in x) and r.random() < 0.9) for x in ids])


def test_chain_uses_out_of_fold():
    """Later models are trained with what models of the other folds say of each text, not with fitted probabilities."""
    ids, y = chain_sample()
    chain = toxicity.fit_chain(ids, y, n_features=20, folds=5)
    assert chain.names == ["kind_1", "kind_2", "toxic"] and [len(m) for m in chain.models] == [21, 22, 23]
    x = np.array([[float(v in i) for v in chain.vocabulary] for i in ids])
    bad = y == 1
    more = x[bad].mean(axis=0) > x[~bad].mean(axis=0)
    kind = np.full(len(y), -1)
    kind[bad] = toxicity.clusters(x[bad][:, more], 2)
    assert (kind == 0).sum() >= (kind == 1).sum() > 0
    for k, label in enumerate([kind == 0, kind == 1, bad]):
        label = label.astype(float)
        assert chain.models[k] == pytest.approx(toxicity.fit_logistic(x, label), abs=1e-4)
        told = np.zeros(len(y))
        for i in range(5):
            own = np.arange(len(y)) % 5 == i
            told[own] = toxicity.predict(x[own], toxicity.fit_logistic(x[~own], label[~own]))
        fitted = toxicity.predict(x, chain.models[k])
        assert toxicity.out_of_fold(x, label, 5, chain.models[k]) == pytest.approx(told, abs=1e-4) and np.abs(told - fitted).max() > 0.05
        x = np.hstack([x, told[:, None]])
    assert toxicity.THRESHOLDS[0] <= chain.threshold <= toxicity.THRESHOLDS[1]


def test_chain_scores_by_brute_force(spark, docs):
    """Probabilities from words, beginnings and weights, one text at a time."""
    hash_of = lambda w: int(words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[2][0])

    def beginning(w):
        h = np.array([7], np.uint64)
        for c in w[: toxicity.PREFIX]:
            h = mix(h + np.uint64(c))
        return int(h[0])

    def features(t):
        raw = "".join(chr(c + 32) if 65 <= c <= 90 else " " if 33 <= c < 127 and not chr(c).isalnum() else chr(c) for c in (t or "").encode())
        found = [w.encode("latin-1") for w in WORD.findall(raw)]
        return {hash_of(w) for w in found} | {beginning(w) for w in found if len(w) > toxicity.PREFIX}

    r = np.random.default_rng(8)
    every = sorted({f for _, t in corpus() for f in features(t)})
    vocabulary = np.array(every[:: max(1, len(every) // 40)], np.uint64)
    chain = toxicity.Chain(["kind_1", "toxic"], vocabulary, [r.normal(size=len(vocabulary) + 1 + k) for k in range(2)], 0.4)
    for row in toxicity.score_toxicity(docs, chain).select("text", "_toxicity.*").collect():
        x = [float(int(v) in features(row.text)) for v in vocabulary]
        for name, w in zip(chain.names, chain.models):
            p = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(x, w)) + w[-1])))
            assert row[f"p_{name}"] == pytest.approx(p, abs=1e-9)
            x.append(p)
        assert row.rejected == (x[-1] >= 0.4)


def brute_classes(rows, n=5, threshold=0.8):
    def shingles(t):
        w = WORD.findall(t or "")
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()

    texts = list(dict.fromkeys(t for _, t in rows))
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    find = lambda i: i if up[i] == i else find(up[i])
    links = Counter()
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = defaultdict(lambda: 2**63)
    where = {t: i for i, t in enumerate(texts)}
    for i, t in rows:
        least[find(where[t])] = min(least[find(where[t])], key(i))
    return [(i, least[find(where[t])] if sets[where[t]] else key(i), links[where[t]]) for i, t in rows]


@pytest.mark.parametrize("how, broadcast", [({}, 9), ({"small": 2, "depth": 2}, 10_000), ({"small": 2, "depth": 3}, 0)])
def test_jaccard_join(spark, docs, empty, monkeypatch, how, broadcast):
    if how:
        monkeypatch.setattr(jaccard_join, "PART", 6)
        monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000)
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 9)
    monkeypatch.setattr(jaccard_join, "BROADCAST_PATHS", broadcast)
    r = random.Random(6)
    rows = corpus()
    for k in range(60):  # a large group of near copies
        w = BASE.split()
        w[r.randrange(len(w))] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    t = docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(corpus()) :], "doc_id long, text string"))
    got = jaccard_join.near_duplicates(t, **how).collect()
    assert Counter((x.doc_id, key(x.class_id), x.n_links) for x in got) == Counter(brute_classes(rows))
    kept = jaccard_join.keep_one_of_each(docs, **how)
    assert kept.columns == docs.columns
    want = Counter(c for _, c, _ in dict.fromkeys(brute_classes(corpus())))
    assert sorted(key(x.doc_id) for x in kept.collect()) == sorted(want)
    assert jaccard_join.near_duplicates(empty).count() == jaccard_join.keep_one_of_each(empty).count() == 0


def test_keep_one_of_each_by_component(spark):
    """Many null ids, and equal ids with different texts: unlike texts stay, and of each class the one with the smallest id."""
    a, b, c = prose(80, 21), prose(80, 22), prose(80, 23)
    unlike = [prose(60, 30 + k) for k in range(6)]
    rows = [(None, t) for t in unlike[:3]] + [(7, t) for t in unlike[3:]] + [(None, a), (4, a), (5, a + " end"), (8, b), (8, b + " end"), (2, c), (7, c), (None, None), (None, ""), (9, None), (9, " \n"), (None, unlike[0])]
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    th = {r.text: r.th for r in t.select("text", F.xxhash64("text").alias("th")).collect()}
    words_of = lambda x: WORD.findall(x or "")
    grams = lambda x: {tuple(words_of(x)[i : i + 5]) for i in range(len(words_of(x)) - 4)}
    classes: list[list] = []
    for i, x in dict.fromkeys(rows):
        like = [k for k in classes if words_of(x) and words_of(k[0][1]) and len(grams(x) & grams(k[0][1])) >= 0.8 * len(grams(x) | grams(k[0][1]))]
        like[0].append((i, x)) if like else classes.append([(i, x)])
    want = [min(k, key=lambda r: (key(r[0]), th[r[1]])) for k in classes]
    assert len(want) == 6 + 3 + 4
    assert Counter((r.doc_id, r.text) for r in jaccard_join.keep_one_of_each(t).collect()) == Counter(want)


def test_runs():
    assert [jaccard_join.runs_needed(0.9, 1), jaccard_join.runs_needed(0.999, 3)] == [3, 10]
    splits = [r for _ in range(20_000) for r in [1]]
    r = random.Random(2)

    def meets(level):
        k, limit = 0, np.exp(-(1.0 if level == 1 else jaccard_join.BRANCH))
        p = r.random()
        while p > limit:
            k, p = k + 1, p * r.random()
        return k > 0 if level == 3 else any([meets(level + 1) for _ in range(k)])

    assert sum(meets(1) for _ in splits) / len(splits) == pytest.approx(jaccard_join.survival(3), abs=0.02)


def test_alike():
    """Components of the pairs that agree, against all pairs."""
    r = np.random.default_rng(4)
    for n in (2, 30, 90):
        base = r.integers(0, 256, (4, jaccard_join.BINS)).astype(np.uint8)
        sig = base[r.integers(0, 4, n)].copy()
        change = r.random(sig.shape) < r.choice([0.1, 0.25, 0.4], (n, 1))
        sig[change] = r.integers(0, 256, int(change.sum()))
        up = list(range(n))
        find = lambda i: i if up[i] == i else find(up[i])
        for i in range(n):
            for j in range(i):
                either = (sig[i] > 0) | (sig[j] > 0)
                if ((sig[i] == sig[j]) & (sig[i] > 0)).sum() >= jaccard_join.LIKELY * either.sum():
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
        assert jaccard_join.alike(sig).tolist() == [find(i) for i in range(n)]


def test_in_common():
    r = np.random.default_rng(5)
    for n, kinds in ((3, 5), (40, 200), (130, 60)):
        has = r.random((n, kinds)) < r.choice([0.02, 0.3, 0.9], kinds)
        token, holder = np.nonzero(has.T)
        many = np.bincount(token, minlength=kinds)
        got = jaccard_join.in_common(holder, many[many > 0], n)
        assert (np.triu(np.rint(got), 1) == np.triu(has.astype(int) @ has.T.astype(int), 1)).all()


def test_many_short_texts_alike_but_not_near(spark):
    """A group of texts that share less than half of their shingles: no links, whatever its size."""
    shared = " ".join(f"w{k}" for k in range(14))
    t = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared + " "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.concat(F.lit("x"), F.col("id"), F.lit("_"), k)), " ")).alias("text"))
    out = jaccard_join.near_duplicates(t)
    assert out.where("n_links = 0 and class_id = doc_id").count() == 6000


def test_mixing(spark, docs, empty):
    rows = [(i, t, f"s{(i or 0) % 4}" if (i or 0) % 5 else None) for i, t in corpus()]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, full = 1.5 * sum(size.values()), {}, set()
    while True:
        rest = total - sum(2 * size[s] for s in full)
        over = {s for s in names if s not in full and rest * weight[s] / sum(weight[x] for x in names if x not in full) > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        target[s] = 2 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full)
    plan = mixing.mixing_plan(docs)
    assert plan.columns == [*docs.columns, "_mix"]
    got = plan.collect()
    copies = Counter()
    for r in got:
        m = r._mix
        assert (m.size, m.source_size, m.target) == (len(WORD.findall(r.text or "")), size[r.source], pytest.approx(target[r.source])) and m.copies <= 2
        rate = target[r.source] / size[r.source]
        assert int(rate) <= m.copies <= int(rate) + (rate > int(rate)) and r._id == "keep"
        copies[(r.doc_id, r.text)] += m.copies
    sizes = spark.createDataFrame([("a", 10), ("b", 0), ("c", 7), (None, 500), ("d", 3)], "source string, size long")
    all_full = {r.source: r.target for r in mixing.source_targets(sizes, (1, 5), 9.0, 2.0).collect()}
    assert all_full == {"a": 20.0, "b": 0.0, "c": 14.0, "d": 6.0, None: 1000.0} and mixing.source_targets(sizes.limit(0), (1, 5), 1.5, 2.0).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == +copies
    assert mixing.mix_documents(empty).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    for r in mixing.mixing_plan(many).groupBy("source").agg(F.sum(F.col("_mix.size") * F.col("_mix.copies")).alias("taken"), F.first("_mix.target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.03)
