"""The property multigraph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELATION_COLOR, TRAIT_COLOR, EVENT_COLOR = "#8899ff", "#33aa66", "#cc8844"


def graph_nodes(entities_canonical: DataFrame, trait_edges: DataFrame) -> DataFrame:
    """(id, label, group, title): entities with their aliases, and each trait once."""
    title = F.when(F.size("aliases") > 0, F.concat(F.lit("Aliases: "), F.array_join("aliases", ", ")))
    entities = entities_canonical.select("id", F.col("name").alias("label"), F.col("type").alias("group"), title.alias("title"))
    traits = trait_edges.select("trait").distinct().select(
        F.concat(F.lit("trait::"), "trait").alias("id"), F.col("trait").alias("label"), F.lit("Trait").alias("group"),
        F.lit(None).cast("string").alias("title")
    )
    return entities.unionByName(traits)


def graph_edges(nodes: DataFrame, relations: DataFrame, trait_edges: DataFrame, only_has_trait: bool = False) -> DataFrame:
    """(src, dst, label, title, color, kind, trait_label): parallel edges stay; edges to what is no node go."""
    ids = nodes.select("id")
    columns = ("src", "dst", "label", "title", "color", "kind", "trait_label")

    def between(df: DataFrame) -> DataFrame:
        return df.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*columns)

    rel = relations.select(
        F.col("head").alias("src"), F.col("tail").alias("dst"), F.col("type").alias("label"),
        F.format_string("surface: %s\nconf: %.2f", F.coalesce("source_label", F.lit("")), F.coalesce("confidence_local", F.lit(0.0))).alias("title"),
        F.lit(RELATION_COLOR).alias("color"), F.lit("relation").alias("kind"), F.lit(None).cast("string").alias("trait_label"),
    )
    kept = trait_edges.where("label = 'HAS_TRAIT'") if only_has_trait else trait_edges
    trait = kept.select(
        F.col("person").alias("src"), F.concat(F.lit("trait::"), "trait").alias("dst"), F.format_string("%.2f/%.2f", "score", "confidence").alias("label"),
        F.concat(F.lit("n_evidence: "), "n_evidence").alias("title"), F.lit(TRAIT_COLOR).alias("color"), F.lit("trait").alias("kind"), F.col("label").alias("trait_label"),
    )
    return between(rel).unionByName(between(trait))


def event_nodes(events: DataFrame) -> DataFrame:
    """Events as nodes of their own, for those who want them in the graph: (id, label, group, title)."""
    return events.select("id", F.col("type").alias("label"), F.lit("Event").alias("group"), F.col("source_label").alias("title"))


def event_edges(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """An edge from each event to each participant that is a node, labelled with its role; columns as graph_edges()."""
    ends = events.select(F.col("id").alias("src"), F.explode("participants_global").alias("p"))
    rows = ends.select("src", F.col("p.entity_id").alias("dst"), F.col("p.role").alias("label"))
    none = F.lit(None).cast("string")
    known = rows.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return known.select("src", "dst", "label", none.alias("title"), F.lit(EVENT_COLOR).alias("color"), F.lit("event").alias("kind"), none.alias("trait_label"))
