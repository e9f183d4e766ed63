"""A training-data pipeline over `documents`: each stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet to the shared
checkpoint folder and reads it again, so that a lost executor costs a task and not the run. All but the last stage return
the columns of documents; n_chars is kept in step with the text. Further columns of any name pass through them; nulls may stand in any column, and an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from quillspan.llm.common import scratch
from quillspan.llm.queries import vocabulary


def _kept_whole(docs: DataFrame) -> DataFrame:
    """Each row in one column beside its id and text, so that no column's name can clash with one that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(_kept_whole(docs), toxicity.train_chain(docs, labels))
    return scored.where(~F.col("_toxicity.rejected")).select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document stays even if nothing of its text does."""
    out = line_dedup.dedup_lines(_kept_whole(docs))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("whole").getField(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return jaccard_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its coin say."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and whether they decode to its text."""
    path, pattern = vocabulary()
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    encoded = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text", digest.alias("_digest")), path, pattern, decoded=True)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("_digest")).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard_join", drop_near_duplicates), ("mixing", mix_sources), ("byte_level_bpe", tokenize)]

#: No stage's rows but those of line dedup and mixing can be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
