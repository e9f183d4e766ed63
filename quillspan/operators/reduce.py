"""Reducers: fusing relations and events across chunks, and the Beta posterior of trait evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAU_SCORE, TAU_CONF, TOP = 0.65, 0.60, 3


def _fuse(rows: DataFrame, keys: Sequence[str | Column], order: str) -> DataFrame:
    """One row per key: the first row's fields, all supports in order (repeats kept), the largest confidence, 0 at least.

    A fused row holds all its supports, as its readers expect; they are gathered as spans of a few numbers, not with their texts."""
    named = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(keys)]
    for n, k in zip(named, keys, strict=True):
        rows = rows if isinstance(k, str) else rows.withColumn(n, k)
    merged = ("supports", "confidence_local", order)
    rest = [c for c in rows.columns if c not in merged and c not in named]
    out = rows.groupBy(*named).agg(
        F.min_by(F.struct(*rest), order).alias("_first"), F.min(order).alias(order),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce("supports", F.array()).alias("supports")))), lambda x: x["supports"])).alias("supports"),
        F.greatest(F.lit(0.0), F.max("confidence_local")).alias("confidence_local"),
    )
    return out.select(*[n for n in named if not n.startswith("_k")], "_first.*", "supports", "confidence_local", order)


def fuse_relations(relations: DataFrame, order: str = "ord", key_polarity: bool = False) -> DataFrame:
    """Relations with the same (type, head, tail, time_norm) are one; nulls count as equal."""
    return _fuse(relations, ["type", "head", "tail", "time_norm", *["polarity"] * key_polarity], order)


def fuse_events(events: DataFrame, order: str = "ord", participants: str = "participants") -> DataFrame:
    """Events with the same type, participants in any order, and time_norm are one."""
    return _fuse(events, ["type", F.array_sort(F.col(participants)), "time_norm"], order)


def beta_posterior(evidence: DataFrame, tau_score: float = TAU_SCORE, tau_conf: float = TAU_CONF, top: int = TOP) -> DataFrame:
    """(person, trait, score, confidence, label, n_evidence, topk) from (person, trait, s, c, span, ord).

    A Beta(1, 1) prior gets s * c for and c - s * c against. The sums and the best `top` spans are all aggregates that combine
    before the shuffle; with no column `span` there is no topk.
    """
    sums = [F.sum(F.col("s") * F.col("c")).alias("_s"), F.sum("c").alias("_n"), F.count(F.lit(1)).alias("n_evidence")]
    keyed = evidence.groupBy("person", "trait").agg(*sums)
    a, b = 1 + F.col("_s"), 1 + F.greatest(F.lit(0.0), F.col("_n") - F.col("_s"))
    keyed = keyed.withColumns({"_a": a, "_b": b})
    a, b = F.col("_a"), F.col("_b")
    score, conf = a / (a + b), F.greatest(F.lit(0.0), 1 - 4 * (a * b / ((a + b) * (a + b) * (a + b + 1))))
    label = F.when((F.col("score") >= tau_score) & (F.col("confidence") >= tau_conf), "HAS_TRAIT").otherwise("CANDIDATE_TRAIT")
    out = keyed.withColumns({"score": score, "confidence": conf}).withColumn("label", label).select("person", "trait", "score", "confidence", "label", "n_evidence")
    if "span" not in evidence.columns:
        return out
    best = top_evidence(evidence, top)
    lists = best.groupBy("person", "trait").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.struct("span.chunk_id", "span.start", "span.end").alias("at")))), lambda x: x["at"]
        ).alias("topk")
    )
    return out.join(lists, ["person", "trait"])


def top_evidence(evidence: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` pieces of evidence of each person and trait by s * c, ties by `ord`; `rank` from 1. Ranks are cut before the shuffle (WindowGroupLimit)."""
    from pyspark.sql import Window

    w = Window.partitionBy("person", "trait").orderBy((F.col("s") * F.col("c")).desc(), "ord")
    return evidence.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
