"""The registered queries against SQL or brute force, and the pipeline stage by stage, at the smallest scale."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    q = con.execute(queries.ORACLES[name])
    names = [c[0] for c in q.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in cols) for r in q.fetchall())


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_substring_queries(spark):
    t = texts(spark)
    got = {r.doc_id: r for r in queries.op2_bwt_intervals(spark, SF).collect()}
    assert got.keys() == t.keys()
    first = {}
    for i in sorted(t):
        b = t[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: r for r in queries.op4_suffix_trees(spark, SF).collect()}
    assert got.keys() == t.keys()
    first = {}
    for i in sorted(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t[i])
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_columns_and_rows(spark):
    n = len(texts(spark))
    want = {
        "op1_quality_crf": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op3_merkle": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op6_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op7_cross_entropy": "doc_id n_tokens lm_score kept", "op8_classifier_chain": "doc_id p_toxic toxic", "op9_chosen_path": "doc_id class_id n_links",
        "op10_mixing": "doc_id size source_size target taken",
    }
    for name, cols in want.items():
        df = queries.QUERIES[name](spark, SF)
        assert df.columns[: len(cols.split())] == cols.split() or set(cols.split()) <= set(df.columns)
        assert df.count() == n


def test_byte_bpe_query(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.VOCABULARY), "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    t = texts(spark)
    for r in queries.op6_byte_bpe(spark, SF).collect():
        ids = exact.encode_ordinary(t[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t[r.doc_id].encode()).hexdigest())


def test_quality_query(spark):
    """The verdict against the best of all labelings of each short text's lines."""
    import numpy as np
    from quillspan.llm import quality_crf as q

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    common = q.common_lines(docs)
    crf = q.train_crf(docs, spark.read.parquet(f"{SF}/labels.parquet"), common)
    t, tried = texts(spark), 0
    for r in queries.op1_quality_crf(spark, SF).collect():
        data = np.frombuffer(t[r.doc_id].encode(), np.uint8)
        g = q.Lines(data, np.array([0, len(data)]), common.hashes)
        if len(g.x) > 10:
            continue
        e, n, tried = g.x @ crf.emit, len(g.x), tried + 1
        best = max(range(2**n), key=lambda m: sum(e[i, m >> i & 1] for i in range(n)) + sum(crf.move[m >> i & 1, m >> i + 1 & 1] for i in range(n - 1)))
        share = sum(int(w) for i, w in enumerate(g.words) if not best >> i & 1) / max(1, r.n_words)
        assert r.content_share == pytest.approx(share) and r.kept == (not r.base_failed and share >= 0.5)
    assert tried > 50


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_by_brute(t):
    """(class_id, n_links) of each document."""
    distinct = list(dict.fromkeys(t.values()))
    sets, up, links = [shingles(x) for x in distinct], list(range(len(distinct))), Counter()
    find = lambda i: i if up[i] == i else find(up[i])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    at = {x: k for k, x in enumerate(distinct)}
    least = {}
    for i in sorted(t):
        least.setdefault(find(at[t[i]]), i)
    return {i: (least[find(at[x])] if sets[at[x]] else i, links[at[x]]) for i, x in t.items()}


def test_chosen_path_query(spark):
    assert {r.doc_id: (r.class_id, r.n_links) for r in queries.op9_chosen_path(spark, SF).collect()} == near_by_brute(texts(spark))


def test_merkle_query(spark):
    """The edited texts, and what equal and unlike fingerprints must say."""
    t = texts(spark)
    order = sorted(t, reverse=True)
    got = {r.doc_id: r for r in queries.op3_merkle(spark, SF).collect()}
    prints = {}
    for k, i in enumerate(order):
        text, other = t[i], t[order[(k + 1) % len(order)]]
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for x, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(x, f) == f
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited == 1.0 if edited == text else True)
    assert len(set(prints.values())) == len(prints)


@pytest.mark.parametrize("change", ["plain", "empty", "nulls", "clashes"])
def test_stages(spark, change):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if change == "empty":
        docs = docs.limit(0)
    if change == "nulls":
        docs = docs.withColumns({c: F.when(F.col("doc_id") % (k + 3) == 0, None).otherwise(F.col(c)) for k, c in enumerate(docs.columns)}).union(docs.limit(3))
    if change == "clashes":
        docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in ("row", "whole", "_id", "_th", "_lines", "_toxicity", "_mix", "_copies", "_once", "ids", "_digest", "root", "v")})
    given = docs.cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SF)
        assert out.columns == docs.columns
        out = out.cache()
        if change == "clashes":
            own = [c for c in docs.columns if c not in ("text", "n_chars")]
            assert not out.select(own).exceptAll(given.select(own).union(given.select(own))).count()
        if name in ("toxicity", "ngram_jaccard_join"):
            assert not out.exceptAll(given).count()
        if name == "ngram_jaccard_join" and change == "plain":
            classes = near_by_brute({r.doc_id: r.text or "" for r in given.collect()})
            assert {r.doc_id for r in out.collect()} == {c for c, _ in classes.values()}
        if name == "line_dedup":
            assert out.count() == given.count() and not out.where("n_chars != length(text)").count() - given.where("n_chars != length(text)").count() > 0
        given = out
    tokens = corpus_pipeline.tokenize(spark, given, SF)
    assert tokens.count() == given.count() and not tokens.where("not round_trip").count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and not out.where("not round_trip").count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
