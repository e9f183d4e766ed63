"""Relations and events of chunks: one reply per chunk; each item is checked by itself and dropped alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..backends import Backend, ask, prompt, settled
from ..functions.jsonx import json_slice
from ..functions.text import slug, trim_ws

SUPPORT = "struct<start:int,end:int,sent_id:int,trigger:struct<start:int,end:int>>"
_COMMON = f"type:string,source_label:string,polarity:string,supports:array<{SUPPORT}>,place:map<string,string>,confidence_local:double,rationale:string"
REPLY = f"struct<relations:array<struct<{_COMMON},head:string,tail:string,modality:string>>,events:array<struct<{_COMMON},status:string,participants:array<struct<role:string,entity_id:string>>>>>"
#: What stands for a missing field.
DEFAULTS = {"polarity": "asserted", "modality": "factual", "status": "completed", "confidence_local": 0.7}


def clip_spans(supports: Column, length: Column) -> Column:
    """Supports with start and end moved into the text."""
    def clip(s: Column) -> Column:
        return F.struct(F.greatest(F.lit(0), s["start"]).alias("start"), F.least(length, s["end"]).alias("end"), s["sent_id"].alias("sent_id"), s["trigger"].alias("trigger"))

    return F.transform(F.coalesce(supports, F.array().cast(f"array<{SUPPORT}>")), clip)


def spans_hold(clipped: Column) -> Column:
    """Whether all clipped supports hold a character and their trigger, if any; true without supports."""
    def holds(s: Column) -> Column:
        t = s["trigger"]
        inside = (s["start"] <= t["start"]) & (t["start"] < t["end"]) & (t["end"] <= s["end"])
        none = t.isNull() | (t["start"].isNull() & t["end"].isNull())
        return (s["start"] < s["end"]) & (s["sent_id"] >= 0) & (none | inside)

    return F.forall(clipped, lambda s: F.coalesce(holds(s), F.lit(False)))


def _common(items: DataFrame, kind: str) -> DataFrame:
    """Checks and defaults that relations and events share; `items` has chunk_id, chunk_ord, pos, length and the item's fields."""
    out = items.withColumn("source_label", trim_ws(F.col("source_label"))).where("source_label != ''")
    out = out.withColumn("type", slug(F.coalesce(F.nullif(F.col("type"), F.lit("")), F.col("source_label"))))
    out = out.withColumn("supports", clip_spans(F.col("supports"), F.col("length"))).where(spans_hold(F.col("supports")))
    for c, v in DEFAULTS.items():
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    out = out.where(F.col("confidence_local").between(0, 1))
    # The support keeps its chunk, as fusion puts supports of several chunks together.
    out = out.withColumn("supports", F.transform("supports", lambda s: s.withField("chunk_id", F.col("chunk_id"))))
    number = F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos")) - 1
    out = out.withColumn("id", F.concat(F.col("chunk_id"), F.lit(f"_{kind}_"), number)).withColumn("time_norm", F.lit(None).cast("string"))
    return out.withColumn("ord", F.struct("chunk_ord", "pos")).drop("length", "pos", "chunk_ord")


def relations_from(items: DataFrame, coref: DataFrame) -> DataFrame:
    """Relations whose head and tail are known entities, by their canonical ids."""
    for end in ("head", "tail"):
        ids = coref.select(F.col("mid").alias(f"_{end}"), F.col("canonical_id").alias(f"_{end}_id"))
        items = items.join(ids, F.concat_ws(":", "chunk_id", end) == F.col(f"_{end}")).withColumn(end, F.col(f"_{end}_id")).drop(f"_{end}", f"_{end}_id")
    return _common(items, "rel")


def events_from(items: DataFrame, coref: DataFrame) -> DataFrame:
    """Events with participants as given and, in participants_global, with canonical ids where they are known."""
    out = _common(items, "evt")
    parts = out.select("id", "chunk_id", F.posexplode("participants").alias("k", "p"))
    known = parts.join(coref, F.concat_ws(":", "chunk_id", F.col("p.entity_id")) == F.col("mid"), "left")
    lists = known.groupBy("id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "k", F.struct(F.col("p.role").alias("role"), F.coalesce("canonical_id", F.col("p.entity_id")).alias("entity_id")).alias("p")
                )
            )
        ).alias("l")
    )
    return out.join(lists.select("id", F.transform("l", lambda x: x["p"]).alias("participants_global")), "id", "left")


def extract_relations(
    chunks: DataFrame, entities: DataFrame, coref: DataFrame, backend: Backend, attempts: int = 1, concurrency: int | None = None, strict: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relations, events, errors). Replies without JSON have no items; malformed ones become errors."""
    listed = entities.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "name", "type", "mentions"))).alias("listed"))
    rows = chunks.select("chunk_id", F.struct("doc_id", "chunk_no").alias("chunk_ord"), "text").join(listed, "chunk_id", "left")

    def build(r: dict) -> tuple[str, str]:
        es = r["listed"] or []
        return prompt("relations", chunk_id=r["chunk_id"], entity_table="\n".join(f"{e['id']} : {e['name']} : {e['type']}" for e in es), entities=es, text=r["text"])

    def check(reply: str, row: dict) -> str | None:
        import json

        a, b = (reply or "").find("{"), (reply or "").rfind("}")
        if a < 0 or b < a:
            return None
        try:
            return None if isinstance(json.loads(reply[a : b + 1]), dict) else "no object"
        except ValueError as e:
            return f"malformed: {e}"

    asked, errors = settled(ask(rows, backend, build, check, attempts, concurrency).drop("listed"), "relations", F.col("chunk_id"), strict)
    parsed = asked.where("failure is null").select("chunk_id", "chunk_ord", F.length("text").alias("length"), F.from_json(json_slice(F.col("reply")), REPLY).alias("r"))
    item = lambda f: parsed.select("chunk_id", "chunk_ord", "length", F.posexplode(f"r.{f}").alias("pos", "i")).select("chunk_id", "chunk_ord", "length", "pos", "i.*")
    return relations_from(item("relations"), coref), events_from(item("events"), coref), errors
