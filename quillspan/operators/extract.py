"""Entity extraction: one reply per chunk, checked and asked for again, then typed rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..backends import Backend, ask, prompt, settled
from ..functions.jsonx import ENTITY_TYPES, parse_entities


def _whole(x: object) -> bool:
    return isinstance(x, int)


def check_entities(reply: str, row: dict) -> str | None:
    """What is wrong with a reply, or None. Mentions out of bounds and entities left without any are dropped, not wrong;
    any other fault of an entity makes the whole reply wrong."""
    a, b = (reply or "").find("{"), (reply or "").rfind("}")
    if a < 0 or b < a:
        return "no JSON object"
    try:
        entities = json.loads(reply[a : b + 1]).get("entities", [])
        for e in entities:
            kept = [m for m in e.get("mentions", []) if all(_whole(m.get(k)) for k in ("start", "end", "sent_id")) and 0 <= m["start"] < m["end"] <= len(row["text"])]
            if kept and (e.get("type") not in ENTITY_TYPES or not isinstance(e.get("name"), str) or not e["name"].strip() or any(m["sent_id"] < 0 for m in kept)):
                return f"bad entity: {e.get('name')!r}"
    except (ValueError, TypeError, AttributeError) as e:
        return f"malformed: {e}"
    return None


def _build(row: dict) -> tuple[str, str]:
    return prompt("entities", chunk_id=row["chunk_id"], text=row["text"], sentence_starts=[s["start"] for s in row["sent_index"]])


def extract_entities(chunks: DataFrame, backend: Backend, max_retries: int = 2, strict: bool = False, concurrency: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, errors) from chunks with sent_index. entities: chunk_id, ord, id, type, name, mentions; errors: stage, key, reason, raw."""

    asked, errors = settled(ask_entities(chunks, backend, max_retries, concurrency), "entities", F.col("chunk_id"), strict)
    return entities_from(asked), errors


def entities_from(asked: DataFrame) -> DataFrame:
    """(chunk_id, ord, id, type, name, mentions) of the accepted replies; works on streams too."""
    good = asked.where("failure is null")
    listed = good.select("chunk_id", F.posexplode(parse_entities(F.col("reply"), F.col("text"))).alias("ord", "e"))
    return listed.select("chunk_id", "ord", F.concat(F.col("chunk_id"), F.lit("_e"), F.col("ord")).alias("id"), "e.type", "e.name", "e.mentions")


def ask_entities(chunks: DataFrame, backend: Backend, max_retries: int = 2, concurrency: int | None = None) -> DataFrame:
    """Chunks with sent_index and what the backend says of their entities: `reply` and `failure`."""
    return ask(chunks.select("chunk_id", "text", "sent_index"), backend, _build, check_entities, max_retries + 1, concurrency)


def entity_table(entities: DataFrame) -> DataFrame:
    """(chunk_id, entity_table): a line `id : name : type` for each entity of the chunk, in order."""
    line = F.concat_ws(" : ", "id", "name", "type")
    rows = entities.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return rows.select("chunk_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("entity_table"))
