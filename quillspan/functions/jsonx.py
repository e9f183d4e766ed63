"""Replies that hold JSON: cutting it out, typed reading, and rules about what survives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws

#: Entity types that may be extracted.
ENTITY_TYPES = ("Person", "Org", "Location", "Artifact", "Concept")
MENTION = "struct<start:int,end:int,sent_id:int>"
ENTITIES = f"struct<entities:array<struct<type:string,name:string,mentions:array<{MENTION}>>>>"


def json_slice(raw: Column) -> Column:
    """From the first { to the last }; null if there is no such part."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def valid_mentions(mentions: Column, length: Column) -> Column:
    """Mentions inside the text, of one character or more, with a sentence."""
    return F.filter(mentions, lambda m: (m["start"] >= 0) & (m["start"] < m["end"]) & (m["end"] <= length) & m["sent_id"].isNotNull())


def parse_entities(raw: Column, text: Column) -> Column:
    """The entities of a reply with their valid mentions, without those that have none; null if the reply holds no JSON."""
    found = F.from_json(json_slice(raw), ENTITIES)["entities"]
    fixed = F.transform(found, lambda e: F.struct(e["type"].alias("type"), trim_ws(e["name"]).alias("name"), valid_mentions(e["mentions"], F.length(text)).alias("mentions")))
    return F.filter(fixed, lambda e: F.size(e["mentions"]) > 0)


def entities_hold(entities: Column) -> Column:
    """Whether all of a reply's entities have a known type, a name and sentences from 0 on; one bad entity spoils the reply."""
    return F.coalesce(F.forall(entities, lambda e: e["type"].isin(*ENTITY_TYPES) & (F.length(e["name"]) > 0) & F.forall(e["mentions"], lambda m: m["sent_id"] >= 0)), F.lit(False))
