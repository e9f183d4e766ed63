"""Persons, their sentence windows, and trait evidence from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..backends import Backend, ask, prompt, settled
from ..functions.jsonx import json_slice
from .chunking import let

WINDOW, METHOD_PRIOR, CONTEXT_QUALITY = 1, 0.70, 0.90
REPLY = "struct<person:string,trait_probs:map<string,double>,evidence:array<struct<span:array<int>,text:string,hedges:array<string>,neg:boolean>>,rationale:string>"


def persons_in_chunks(entities: DataFrame, coref: DataFrame) -> DataFrame:
    """(chunk_id, canonical_id, display_name, local_id, mentions) of each person with a canonical id; one row per local entity."""
    people = entities.where("type = 'Person'").withColumn("mid", F.concat_ws(":", "chunk_id", "id"))
    return people.join(coref, "mid").select("chunk_id", "canonical_id", F.col("name").alias("display_name"), F.col("id").alias("local_id"), "mentions")


def window_bounds(sents: Column, sent_id: Column, size: int = WINDOW) -> Column:
    """The sentences from `size` before to `size` after; empty from `size` past the end on."""
    lo, hi = F.greatest(F.lit(0), sent_id - size), F.least(F.size(sents), sent_id + size + 1)
    return F.when(hi > lo, F.slice(sents, lo + 1, hi - lo)).otherwise(F.slice(sents, 1, 0))


def person_windows(people: DataFrame, chunks: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, errors): a window for each person of a chunk and distinct sentence, cut out beside the chunk's text; sentences beyond the last become errors."""
    def cut_out(center: Column, w: Column) -> Column:
        start, end = F.get(w, F.lit(0))["start"], F.try_element_at(w, F.lit(-1))["end"]
        return F.struct(
            center.alias("sent_id_center"), F.transform(w, lambda s: s["sent_id"]).alias("sent_ids"), start.alias("start"), end.alias("end"),
            F.substring(F.col("text"), start + 1, end - start).alias("text"), ((center <= F.size("sent_index")) & (F.size(w) > 0)).alias("there"),
        )

    def window(center: Column) -> Column:
        return let(window_bounds(F.col("sent_index"), center, size), lambda w: cut_out(center, w))

    centers = F.array_sort(F.array_distinct(F.transform("mentions", lambda m: m["sent_id"])))
    rows = people.select("chunk_id", "canonical_id", "display_name", "local_id", centers.alias("centers")).join(chunks.select("chunk_id", "text", "sent_index"), "chunk_id")
    rows = rows.select("chunk_id", "canonical_id", "display_name", "local_id", F.explode(F.transform("centers", window)).alias("w"))
    windows = rows.where("w.there").select("chunk_id", "canonical_id", "display_name", "w.sent_id_center", "w.sent_ids", "w.start", "w.end", "w.text")
    bad = rows.where("not w.there").select(
        F.lit("windows").alias("stage"), F.concat_ws(":", "chunk_id", "local_id").alias("key"), F.lit("no such sentence").alias("reason"),
        F.col("w.sent_id_center").cast("string").alias("raw"),
    )
    return windows, bad


def calibrate(probs: Column) -> Column:
    """Probabilities moved into [0, 1]; NaN counts as 1."""
    return F.transform_values(probs, lambda k, v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def evidence_holds(evidence: Column) -> Column:
    return F.coalesce(F.forall(evidence, lambda e: (F.size(e["span"]) == 2) & (F.get(e["span"], F.lit(0)) >= 0) & (F.get(e["span"], F.lit(0)) < F.get(e["span"], F.lit(1)))), F.lit(False))


def to_evidence(parsed: DataFrame, method_prior: float = METHOD_PRIOR, context_quality: float = CONTEXT_QUALITY, use_negation: bool = False) -> DataFrame:
    """(person, trait, s, c, span, method, rationale, ord): a row per trait of a reply that shows evidence, at its first piece's place.

    `parsed` has canonical_id, chunk_id, sent_id_center, sent_ids, start and the reply `r`. With `use_negation` a negated first
    piece turns the probability round.
    """
    shown = parsed.where(F.size(F.coalesce("r.evidence", F.array().cast("array<struct<span:array<int>,text:string,hedges:array<string>,neg:boolean>>"))) > 0).where(evidence_holds(F.col("r.evidence")))
    first = F.get(F.col("r.evidence"), F.lit(0))
    rows = shown.select("canonical_id", "chunk_id", "sent_id_center", "sent_ids", "start", first.alias("e"), F.explode(calibrate(F.col("r.trait_probs"))).alias("trait", "s"))
    s = F.when(F.col("e.neg"), 1 - F.col("s")).otherwise(F.col("s")) if use_negation else F.col("s")
    span = F.struct("chunk_id", (F.col("start") + F.col("e.span")[0]).alias("start"), (F.col("start") + F.col("e.span")[1]).alias("end"), "sent_ids")
    return rows.select(
        F.col("canonical_id").alias("person"), "trait", s.alias("s"), (F.lit(method_prior) * F.lit(context_quality)).alias("c"), span.alias("span"),
        F.array(F.lit("llm")).alias("method"), F.lit(None).cast("string").alias("rationale"), F.struct("chunk_id", "sent_id_center", "trait").alias("ord")
    )


def extract_traits(windows: DataFrame, backend: Backend, attempts: int = 1, dedupe: bool = False, strict: bool = False, **how) -> tuple[DataFrame, DataFrame]:
    """(evidence, errors). With `dedupe` equal windows of overlapping chunks count once."""

    def build(r: dict) -> tuple[str, str]:
        return prompt("traits", person=r["display_name"], text=r["text"])

    def check(reply: str, row: dict) -> str | None:
        import json

        a, b = (reply or "").find("{"), (reply or "").rfind("}")
        if a < 0 or b < a:
            return None
        try:
            json.loads(reply[a : b + 1])
        except ValueError as e:
            return f"malformed: {e}"
        return None

    rows = windows.dropDuplicates(["canonical_id", "text"]) if dedupe else windows
    asked, errors = settled(ask(rows, backend, build, check, attempts), "traits", F.concat_ws(":", "chunk_id", "canonical_id"), strict)
    parsed = asked.where("failure is null").withColumn("r", F.from_json(json_slice(F.col("reply")), REPLY))
    return to_evidence(parsed, **how), errors
