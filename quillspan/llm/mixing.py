"""Mixing sources to target weights.

Each source gets a share of the mix by its weight, but never more than `max_rate` times what it holds; what it
cannot take goes to the others by weight. A document is emitted floor(rate) times, plus once more if a coin seeded by
its id shows a number below the rate's fraction. DataFrame functions only.

Rows: one per row of the input. Null texts have size 0; the null source is a source of its own, the last in order.
Repeated rows (and rows with equal ids) throw the same coin, so that reruns and repartitioning change nothing; a null id's coin comes from the text.
Very long texts only count more. Input columns may have any name but `_mix`, which is replaced.
An empty table gives an empty result. Sources without words get target 0 and no copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import count_words, cut, packed, release, unpacked

#: The targets are broadcast up to so many sources, else joined by shuffle (AQE splits a hot source).
BROADCAST_SOURCES = 100_000


def coin(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the seed and the id alone; of a row without an id, from its text."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), own))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_rate: float) -> DataFrame:
    """(source, source_size, target), a cut, from rows (source, size).

    The fixed point of resharing the excess is a water level: a source takes least(cap, weight * level). Each round sums the caps of
    the sources that are full at the level so far and shares what is left among the weights of the others; full sources stay
    full, so the level only rises, and rounds end when no source fills. Sources are one row each and only sums of them meet.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_none", F.col("source").isNull())
    by_name = numbered(per, "_none", "source")  # null last
    w = F.array(*[F.lit(float(x)) for x in weights])
    weight = F.element_at(w, (F.col("number") % len(weights) + 1).cast("int"))
    per = cut(by_name.select("source", "source_size", weight.alias("_w"), (F.lit(float(max_rate)) * F.col("source_size")).alias("_cap")))
    release(by_name._uses)
    sums = per.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    total, taken, open_w = float(share) * (sums["size"] or 0), 0.0, sums["w"] or 0.0
    while True:
        level = (total - taken) / open_w if open_w else float("inf")
        full = F.col("_cap") / F.col("_w") <= F.lit(level)
        now = per.agg(F.sum(F.when(full, F.col("_cap"))).alias("cap"), F.sum(F.when(~full, F.col("_w"))).alias("w")).first()
        now = (now["cap"] or 0.0, now["w"] or 0.0)
        if now == (taken, open_w):
            break
        taken, open_w = now
    out = cut(per.select("source", "source_size", F.when(full, F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.lit(level))).alias("target")))
    release(per)
    return out


def mixing_plan(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_rate: float = 2.0, seed: int = 17, source: str = "source",
    text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The columns of `docs` and a struct `_mix` (size, source_size, target, rate, copies)."""
    size = count_words(F.col(text))
    targets = source_targets(docs.select(F.col(source).alias("source"), size.alias("size")), weights, share, max_rate)
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = targets.select(F.struct("source", "source_size", "target").alias("_t"))
    right = F.broadcast(right) if small else right
    row = F.col("row")
    out = packed(docs).withColumn("_size", count_words(row.getField(text))).join(right, row.getField(source).eqNullSafe(F.col("_t.source")), "left")
    rate = F.when(F.col("_t.source_size") > 0, F.col("_t.target") / F.col("_t.source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("_rate", rate)
    once_more = (coin(seed, row.getField(doc_id), row.getField(text)) < F.col("_rate") - F.floor("_rate")).cast("long")
    mix = F.struct(
        F.col("_size").alias("size"), F.col("_t.source_size").alias("source_size"), F.col("_t.target").alias("target"), F.col("_rate").alias("rate"),
        (F.floor("_rate") + once_more).alias("copies")
    )
    return unpacked(out.withColumn("_mix", mix), docs.columns, "_mix")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as the plan says, with the columns of `docs`."""
    whole = packed(docs)
    inner = whole.select("row", *[F.col("row").getField(how.get(c, c)).alias(c) for c in ("source", "text", "doc_id")])
    plan = mixing_plan(inner, **{k: v for k, v in how.items() if k not in ("source", "text", "doc_id")})
    copies = plan.select("row", F.explode(F.array_repeat(F.lit(1), F.col("_mix.copies").cast("int"))))
    return unpacked(copies, docs.columns)
