"""Streaming forms: chunks and entities of a stream of documents without state, and running trait sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..backends import Backend
from ..operators import chunking, extract


def stream_chunks(docs: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Chunks with sent_index of a stream of documents: each document by itself, no state."""
    return chunking.chunks_with_sentences(docs, size, overlap)


def stream_entities(chunks: DataFrame, backend: Backend, max_retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(entities, errors) of a stream of chunks. A batch that is run again after a failure asks again."""
    asked = extract.ask_entities(chunks, backend, max_retries)
    return extract.entities_from(asked), asked.where("failure is not null").select(F.lit("entities").alias("stage"), F.col("chunk_id").alias("key"), F.col("failure").alias("reason"), F.col("reply").alias("raw"))


def stream_trait_sums(evidence: DataFrame, time: str = "ts", delay: str = "1 hour", window: str | None = None) -> DataFrame:
    """Running (person, trait, s_sum, c_sum, n_evidence) of a stream of evidence, per event-time window if one is given.

    Late rows count until the watermark passes them; beta_of_sums() turns the sums into scores at any time.
    """
    keys = [F.window(time, window).alias("window")] if window else []
    return evidence.withWatermark(time, delay).groupBy(*keys, "person", "trait").agg(F.sum(F.col("s") * F.col("c")).alias("s_sum"), F.sum("c").alias("c_sum"), F.count(F.lit(1)).alias("n_evidence"))


def beta_of_sums(sums: DataFrame) -> DataFrame:
    """Adds score and confidence under the Beta(1, 1) prior."""
    a, b = 1 + F.col("s_sum"), 1 + F.greatest(F.lit(0.0), F.col("c_sum") - F.col("s_sum"))
    return sums.withColumns({"score": a / (a + b), "confidence": F.greatest(F.lit(0.0), 1 - 4 * a * b / ((a + b) * (a + b) * (a + b + 1)))})
