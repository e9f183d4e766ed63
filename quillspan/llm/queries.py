"""The queries of this subpackage: each applies its operator to the whole of its table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bwt_dedup, jaccard_join, line_dedup, lm_words, merkle, mixing, quality_crf, suffix_trees, toxicity
from .common import documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def vocabulary() -> tuple[str, str]:
    """(path, pattern) of the public vocabulary that is used."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    common = quality_crf.common_lines(docs)
    judged = quality_crf.judge_quality(docs, quality_crf.train_crf(docs, _labels(spark, sf_dir), common), common)
    q = F.col("_quality")
    return judged.select("doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")])


def op2_bwt_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwt_dedup.remove_repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(documents(spark, sf_dir).select("doc_id", "text"))


def op4_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_trees.remove_repeated_words(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col("_lines.n_lines").alias("n_lines"), F.col("_lines.n_removed").alias("n_removed"), kept.alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    out = bpe.encode_texts(documents(spark, sf_dir).select("doc_id", "text"), path, pattern, decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_words.cross_entropy_difference(documents(spark, sf_dir), _labels(spark, sf_dir))


def op8_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = toxicity.train_chain(docs, _labels(spark, sf_dir))
    return toxicity.score_toxicity(docs, chain).select("doc_id", *[F.col(f"_toxicity.p_{n}").alias(f"p_{n}") for n in chain.names], F.col("_toxicity.rejected").alias("toxic"))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(documents(spark, sf_dir).select("doc_id", "source", "text"))
    m = F.col("_mix")
    return plan.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_crf": op1_quality_crf, "op2_bwt_intervals": op2_bwt_intervals, "op3_merkle": op3_merkle, "op4_suffix_trees": op4_suffix_trees, "op5_line_windows": op5_line_windows, "op6_byte_bpe": op6_byte_bpe,
    "op7_cross_entropy": op7_cross_entropy, "op8_classifier_chain": op8_classifier_chain, "op9_chosen_path": op9_chosen_path, "op10_mixing": op10_mixing,
}

OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, x, n, unnest(range(0, n)) AS p FROM d),
w AS (SELECT doc_id, p, substr(x, CAST(2 * p + 1 AS BIGINT), 2) AS byte, CASE WHEN p + 50 <= n THEN substr(x, CAST(2 * p + 1 AS BIGINT), 100) END AS win FROM b),
f AS (SELECT doc_id, p, byte, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS later FROM w),
c AS (SELECT doc_id, p, byte, bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM c),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
b AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d),
w AS (SELECT doc_id, p, l[p] AS word, CASE WHEN p + 12 <= len(l) THEN array_to_string(l[p:p + 12], ' ') END AS win FROM b),
f AS (SELECT doc_id, p, word, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS later FROM w),
c AS (SELECT doc_id, p, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY min(doc_id)) AS k, min(doc_id) AS least, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents GROUP BY text),
g AS (SELECT DISTINCT k, array_to_string(l[p:p + 4], ' ') AS s FROM (SELECT k, l, unnest(range(1, greatest(2, len(l) - 3))) AS p FROM t WHERE len(l) > 0)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
c AS (SELECT x.k AS a, y.k AS b, count(*) AS m FROM g x JOIN g y ON x.s = y.s AND x.k < y.k GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 10 * m >= 8 * (x.n + y.n - m)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT k AS v, k AS w FROM t UNION SELECT v, s.b FROM r JOIN s ON s.a = w),
m AS (SELECT v, min(least) AS class_id FROM r JOIN t ON t.k = w GROUP BY v),
o AS (SELECT k, class_id, (SELECT count(*) FROM s WHERE s.a = k) AS n_links, l FROM t JOIN m ON v = k),
own AS (SELECT doc_id, k FROM documents JOIN (SELECT min(doc_id) AS least, text AS same FROM documents GROUP BY text) q ON documents.text IS NOT DISTINCT FROM q.same JOIN t USING (least))
SELECT doc_id, CASE WHEN len(l) > 0 THEN class_id ELSE doc_id END AS class_id, CAST(n_links AS BIGINT) AS n_links FROM own JOIN o USING (k)
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS p, l FROM d WHERE len(l) >= 3),
k AS (SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS k FROM w),
o AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM k),
gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM o WHERE n > 1),
gl AS (SELECT doc_id, list(p) AS gp FROM gone GROUP BY doc_id),
r AS (SELECT d.doc_id, l, coalesce(gp, []) AS gp FROM d LEFT JOIN gl USING (doc_id)),
s AS (SELECT doc_id, l, gp, list_filter(range(0, len(l)), lambda i: NOT list_contains(gp, i)) AS keep FROM r)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(gp) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(keep, lambda i: l[i + 1]), chr(10)), '')) AS kept_sha256
FROM s
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS own FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(k - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, sum(cap) OVER o + cap / w * (sum(w) OVER () - sum(w) OVER o) <= total AS is_full FROM w
      WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, w * ((total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0))
      / sum(CASE WHEN NOT is_full THEN w END) OVER ())) END AS target FROM f),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('17:' || own), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS coin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

ORACLES = {"op2_bwt_intervals": OP2_SQL, "op4_suffix_trees": OP4_SQL, "op5_line_windows": OP5_SQL, "op9_chosen_path": OP9_SQL, "op10_mixing": OP10_SQL}
