"""The whole way from documents to a graph."""

from __future__ import annotations

import logging
import time
from functools import reduce

from pyspark.sql import DataFrame

from ..backends import Backend, RulesBackend, refuse
from ..operators import chunking, extract, graph, reduce as reducers, relations, resolve, traits
from ..session import cut

log = logging.getLogger("quillspan")


def run_pipeline(
    docs: DataFrame, backend: Backend | None = None, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, concurrency: int | None = None, event_key: str = "local",
    key_polarity: bool = False, dedupe: bool = False, use_negation: bool = False, only_has_trait: bool = False, strict: bool = False, with_events: bool = False,
) -> dict[str, DataFrame]:
    """The tables of every stage by name. Events stay out of the graph, unless `with_events` makes them nodes.

    Chunks, replies and resolved ids are written to the shared folder when a stage ends, so that no reply is asked for twice and all
    tables tell the same; each end is logged. Rows without an accepted reply are rows of `errors`; with `strict` the first one raises StageFailed.
    """
    backend = backend or RulesBackend()
    began = time.monotonic()

    def done(stage: str) -> None:
        log.info("%s done after %.1f s", stage, time.monotonic() - began)

    chunks = cut(chunking.chunks_with_sentences(docs, size, overlap))
    done("chunks")
    entities, errors1 = extract.extract_entities(chunks, backend, strict=strict, concurrency=concurrency)
    done("entities")
    canonical, coref, errors2 = resolve.resolve_entities(entities, chunks, backend, strict=strict)
    canonical, coref = cut(canonical), cut(coref)
    done("resolution")
    rels, events, errors3 = relations.extract_relations(chunks, entities, coref, backend, concurrency=concurrency, strict=strict)
    done("relations and events")
    windows, errors4 = traits.person_windows(traits.persons_in_chunks(entities, coref), chunks)
    refuse(errors4, strict)
    evidence, errors5 = traits.extract_traits(windows, backend, dedupe=dedupe, use_negation=use_negation, strict=strict)
    done("traits")
    fused = reducers.fuse_relations(rels, key_polarity=key_polarity)
    fused_events = reducers.fuse_events(events, participants="participants_global" if event_key == "global" else "participants")
    trait_edges = reducers.beta_posterior(evidence)
    nodes = graph.graph_nodes(canonical, trait_edges)
    edges = graph.graph_edges(nodes, fused, trait_edges, only_has_trait)
    if with_events:
        nodes, edges = nodes.unionByName(graph.event_nodes(fused_events)), edges.unionByName(graph.event_edges(nodes, fused_events))
    errors = reduce(DataFrame.unionByName, [errors1, errors2, errors3, errors4, errors5])
    return {
        "chunks": chunks, "entities": entities, "entities_canonical": canonical, "coref": coref, "relations": rels, "events": events, "windows": windows, "evidence": evidence,
        "relations_fused": fused, "events_fused": fused_events, "trait_edges": trait_edges, "nodes": nodes, "edges": edges, "errors": errors,
    }
