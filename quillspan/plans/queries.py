"""Queries over the test tables, one or more for each group of operators, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, text as tx
from ..operators import chunking, extract, graph, reduce, relations, resolve, traits
from ..session import table
from .pipeline import run_pipeline

SENTENCES = r"""
parts AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?]+["”'']?\s+|\n{2,})', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
seg AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS part FROM parts),
spans AS (SELECT doc_id, k, CAST(coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
          length(regexp_replace(part, '\s+$', '')) AS n FROM seg),
sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sent_id, s AS b, CAST(s + n AS BIGINT) AS e FROM spans WHERE n > 0)
"""
EVIDENCE = "ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS person, event_type AS trait, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 50)) AS s, 0.7::DOUBLE * 0.9::DOUBLE AS c FROM events)"
BETA = f"""{EVIDENCE},
g AS (SELECT person, trait, 1 + sum(s * c) AS a, 1 + greatest(0, sum(c) - sum(s * c)) AS b, count(*) AS n FROM ev GROUP BY ALL),
te AS (SELECT person, trait, a / (a + b) AS score, greatest(0, 1 - 4 * (a * b / ((a + b) * (a + b) * (a + b + 1)))) AS confidence, n FROM g)"""
LCS = """
names AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^0-9a-z_]+', ' ', 'g')) AS n FROM part),
pairs AS (SELECT a.n AS a, b.n AS b, string_split(a.n, '') AS al, string_split(b.n, '') AS bl FROM names a JOIN names b ON substr(a.n, 1, 1) = substr(b.n, 1, 1) AND a.n < b.n AND a.n <> ''),
dp AS (SELECT a, b, al, bl, 0 AS i, list_transform(range(0, len(bl) + 1), lambda x: 0) AS old FROM pairs
  UNION ALL SELECT a, b, al, bl, i + 1, list_transform(range(0, len(bl) + 1), lambda j: coalesce(list_max(list_transform(range(1, j + 1), lambda k: greatest(old[k + 1], CASE WHEN bl[k] = al[i + 1] THEN old[k] + 1 ELSE 0 END))), 0)) FROM dp WHERE i < len(al)),
lcs AS (SELECT a, b, list_max(old) AS l FROM dp WHERE i = len(al)),
tok AS (SELECT a, b, l, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM lcs),
sim AS (SELECT a, b, 0.6::DOUBLE * (len(list_intersect(ta, tb))::DOUBLE / greatest(1, len(list_distinct(list_concat(ta, tb))))) + 0.4::DOUBLE * (l::DOUBLE / greatest(length(a), length(b))) AS sim FROM tok)
"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 50))
    return e.select("event_id", F.col("user_id").cast("string").alias("person"), F.col("event_type").alias("trait"), s.alias("s"), (F.lit(0.7) * F.lit(0.9)).alias("c"), F.col("event_id").alias("ord"))


def trait_beta(spark: SparkSession, d: str) -> DataFrame:
    out = reduce.beta_posterior(_evidence(spark, d))
    return out.select("person", "trait", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "label", "n_evidence")


def trait_topk(spark: SparkSession, d: str) -> DataFrame:
    return reduce.top_evidence(_evidence(spark, d)).select("person", "trait", F.col("rank").cast("long").alias("rank"), "event_id", F.round(F.col("s") * F.col("c"), 6).alias("weight"))


def calibrate_clamp(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,double>").alias("m"), "value")
    probs = F.transform_values("m", lambda k, v: v / 50 - 0.2)
    return e.select("event_id", F.explode(traits.calibrate(probs)).alias("trait", "s")).select("event_id", "trait", F.round("s", 6).alias("s"), F.round(F.lit(0.7) * F.lit(0.9), 6).alias("c"))


def sentence_index(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.sentence_index(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", *[F.col(c).cast("long").alias(n) for c, n in (("sent_id", "sent_id"), ("start", "b"), ("end", "e"))])


def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each sentence with its neighbours, cut out where the text is."""
    out = table(spark, d, "documents").select("doc_id", F.explode(chunking.sentence_windows(F.col("text"))).alias("x"))
    return out.select("doc_id", *[F.col(f"x.{c}").cast("long").alias(n) for c, n in (("sent_id", "sent_id"), ("start", "b"), ("end", "e"), ("n_sents", "n_sents"))], F.md5("x.text").alias("window_md5"))


def _hits(text: Column, word: str) -> Column:
    """Where `word` occurs in a text, from 0, not overlapping."""
    parts = F.split(text, word, -1)

    def add(acc: Column, part: Column) -> Column:
        at = acc["at"] + F.length(part)
        return F.struct((at + len(word)).alias("at"), F.concat(acc["hits"], F.array(at)).alias("hits"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), none, add)["hits"]


def person_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every "th" of a text mentions the person of the text's language."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text", F.concat(F.lit("p"), "lang").alias("who"))
    chunks = chunking.with_sentences(docs)
    sent = lambda index, at: F.size(F.filter(index, lambda s: s["start"] <= at)) - 1
    # The index is bound first: as a column it could be computed anew for each hit.
    mentions = chunking.let(
        F.col("sent_index"),
        lambda index: F.transform(_hits(F.col("text"), "th"), lambda at: F.struct(at.alias("start"), (at + 2).alias("end"), sent(index, at).alias("sent_id"))),
    )
    named = chunks.withColumn("m", mentions).where(F.size("m") > 0)
    entities = named.select("chunk_id", F.lit("e0").alias("id"), F.lit("Person").alias("type"), F.col("who").alias("name"), F.col("m").alias("mentions"))
    coref = named.select(F.concat("chunk_id", F.lit(":e0")).alias("mid"), F.col("who").alias("canonical_id"))
    windows, _ = traits.person_windows(traits.persons_in_chunks(entities, coref), chunks.drop("who"))
    return windows.select(
        "chunk_id", "canonical_id", F.col("sent_id_center").cast("long").alias("sent_id"), F.col("start").cast("long").alias("b"),
        F.col("end").cast("long").alias("e"), F.md5("text").alias("window_md5")
    )


def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("len"))
    out = chunking.chunk_offsets(c, ["conv_id"], "turn", "len", 150)
    return out.select("conv_id", "turn", F.col("start_idx").cast("long").alias("b"), F.col("end_idx").cast("long").alias("e"))


def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_documents(table(spark, d, "documents"))


def json_entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    mention = F.format_string('{"start": %d, "end": %d, "sent_id": 0}', k - 10, k)
    raw = F.concat(
        F.lit('Here: {"entities": [{"type": "Concept", "name": " '), "event_type", F.lit(' ", "mentions": ['), mention,
        F.lit(', {"start": 5, "end": 5, "sent_id": 0}]}, {"type": "Org", "name": "x", "mentions": []}]} done')
    )
    e = table(spark, d, "events").select("event_id", raw.alias("raw"), F.lit("x" * 60).alias("text"))
    e = e.select("event_id", jsonx.parse_entities(F.col("raw"), F.col("text")).alias("es")).where(jsonx.entities_hold(F.col("es")))
    e = e.select("event_id", F.posexplode("es").alias("ord", "e"))
    return e.select(
        "event_id", F.concat(F.col("event_id"), F.lit("_e"), F.col("ord")).alias("id"), "e.type", "e.name",
        F.col("e.mentions")[0]["start"].cast("long").alias("b"), F.size("e.mentions").cast("long").alias("n_mentions")
    )


def slug_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", tx.slug(F.concat_ws(" - ", "p_type", "p_brand", F.lit("Café!"))).alias("slug"), tx.slug(F.when(F.col("p_size") % 2 == 0, "??")).alias("fallback"))


def _relation_items(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    chunk = F.concat(F.lit("c_"), F.col("o_orderkey") % 50)
    support = F.array(F.struct(F.lit(-3).alias("start"), (F.col("o_custkey") % 30).cast("int").alias("end"), F.lit(0).alias("sent_id"), F.lit(None).cast("struct<start:int,end:int>").alias("trigger")))
    return o.select(chunk.alias("chunk_id"), F.lit(1).alias("chunk_ord"), F.col("o_orderkey").alias("pos"), F.lit(20).alias("length"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("type"),
        F.when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("source_label"), F.concat(F.lit("e"), F.col("o_custkey") % 100).alias("head"), F.concat(F.lit("e"), F.col("o_orderkey") % 70).alias("tail"),
        F.lit(None).cast("string").alias("polarity"), F.lit(None).cast("string").alias("modality"), support.alias("supports"), F.when(F.col("o_orderkey") % 11 == 0, 1.2).alias("confidence_local"))


def relation_lookup(spark: SparkSession, d: str) -> DataFrame:
    mids = spark.range(50).crossJoin(spark.range(60).withColumnRenamed("id", "e")).select(
        F.concat(F.lit("c_"), "id", F.lit(":e"), "e").alias("mid"), F.concat(F.lit("ent_"), "e").alias("canonical_id")
    )
    out = relations.relations_from(_relation_items(spark, d), mids)
    return out.select(
        "id", "type", "head", "tail", "polarity", "modality", "confidence_local", F.col("supports")[0]["start"].cast("long").alias("b"),
        F.col("supports")[0]["end"].cast("long").alias("e")
    )


def span_clip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    end = (F.col("n_chars") - 50 + 100 * F.col("quality")).cast("int")
    trigger = F.struct(F.lit(0).alias("start"), F.lit(400).alias("end"))
    support = F.struct((F.col("toxic") * 600 - 5).cast("int").alias("start"), end.alias("end"), F.lit(0).alias("sent_id"), F.when(F.col("doc_id") % 2 == 0, trigger).alias("trigger"))
    c = relations.clip_spans(F.array(support), F.length("text"))
    return rows.select("doc_id", c[0]["start"].cast("long").alias("b"), c[0]["end"].cast("long").alias("e"), relations.spans_hold(c).alias("kept"))


def entity_table(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(
        F.col("n_regionkey").cast("string").alias("chunk_id"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("e"), "n_nationkey").alias("id"),
        F.col("n_name").alias("name"), F.lit("Location").alias("type")
    )
    return extract.entity_table(n)


def relation_fuse(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    support = F.array(F.struct(F.col("l_orderkey").alias("start"), F.col("l_linenumber").alias("end")))
    rows = li.select(
        F.col("l_returnflag").alias("type"), F.concat(F.lit("s"), "l_suppkey").alias("head"), F.col("l_linestatus").alias("tail"),
        F.lit(None).cast("string").alias("time_norm"), F.col("l_linenumber").alias("polarity"), support.alias("supports"),
        (F.col("l_discount") * 10).alias("confidence_local"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("ord")
    )
    out = reduce.fuse_relations(rows)
    places = F.array_join(F.transform("supports", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select(
        "type", "head", "tail", F.col("polarity").cast("long").alias("first_line"), F.size("supports").cast("long").alias("n_supports"),
        F.md5(places).alias("supports_md5"), F.round("confidence_local", 6).alias("confidence")
    )


def event_fuse(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    p = lambda r, e: F.struct(F.lit(r).alias("role"), e.cast("string").alias("entity_id"))
    a, b = p("speaker", F.col("conv_id") % 5), p("topic", F.col("turn") % 3)
    rows = c.select(
        F.col("role").alias("type"), F.when(F.col("turn") % 2 == 0, F.array(a, b)).otherwise(F.array(b, a)).alias("participants"),
        F.lit(None).cast("string").alias("time_norm"), F.array(F.struct("conv_id", "turn")).alias("supports"), F.lit(0.7).alias("confidence_local"),
        F.struct("conv_id", "turn").alias("ord"), F.col("conv_id").alias("first_conv")
    )
    out = reduce.fuse_events(rows)
    key = F.array_join(F.transform(F.array_sort("participants"), lambda x: F.concat_ws("=", x["role"], x["entity_id"])), ",")
    return out.select("type", key.alias("participants"), "first_conv", F.size("supports").cast("long").alias("n_supports"), F.col("confidence_local").alias("confidence"))


def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("k"), F.concat_ws("_x ", "p_name", "p_brand").alias("n")).union(
        table(spark, d, "customer").select(
            F.concat(F.lit("c"), "c_custkey"), F.concat_ws(" É\u00df\ufb01 ", "c_name", "c_mktsegment")
        )
    )
    return names.select("k", tx.normalize_name("n").alias("norm"))


def name_normalize_texts(spark: SparkSession, d: str) -> DataFrame:
    """normalize_name over every whole text. SQL's functions for accents do not follow it there; it is tested against plain_name."""
    return table(spark, d, "documents").select("doc_id", tx.normalize_name("text").alias("norm"))


def _first_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("chunk_id"), F.lit("e0").alias("id"), F.col("lang").alias("type"),
        F.split("text", "\n")[0].alias("name")
    )


def exact_merge(spark: SparkSession, d: str) -> DataFrame:
    m = resolve.mentions_of(_first_lines(spark, d), F.lower("name"))
    return resolve.exact_edges(m)


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    e = docs.select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("chunk_id"), F.lit("e0").alias("id"), F.lit("Concept").alias("type"),
        F.regexp_extract("text", r"^[A-Za-z]+[^A-Za-z]?", 0).alias("name")
    )
    m = resolve.mentions_of(e, tx.normalize_ascii(F.col("name")))
    canonical, _ = resolve.canonical_entities(m, resolve.exact_edges(m))
    return canonical.select("id", "name", F.array_join("aliases", "|").alias("aliases"), F.size("members").cast("long").alias("n_members"), F.element_at("members", 1).alias("root"))


def _part_mentions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    e = p.select(F.lit("c").alias("chunk_id"), F.lpad(F.col("k").cast("string"), 9, "0").alias("id"), F.lit("Artifact").alias("type"), F.col("p_name").alias("name"))
    return resolve.mentions_of(e, tx.normalize_ascii(F.col("name")))


def band_pairs(spark: SparkSession, d: str) -> DataFrame:
    return resolve.band_pairs(_part_mentions(spark, d)).select(F.col("a_norm").alias("a"), F.col("b_norm").alias("b"))


def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    pairs = resolve.band_pairs(_part_mentions(spark, d))
    native = tx.name_similarity(F.col("a_norm"), F.col("b_norm"), tx.lcs_length(F.col("a_norm"), F.col("b_norm")))
    return pairs.select(F.col("a_norm").alias("a"), F.col("b_norm").alias("b"), F.round(native, 6).alias("sim"))


def sim_route(spark: SparkSession, d: str) -> DataFrame:
    return resolve.route(resolve.band_pairs(_part_mentions(spark, d))).select(F.col("a_norm").alias("a"), F.col("b_norm").alias("b"), "route")


def entity_clusters(spark: SparkSession, d: str) -> DataFrame:
    m = _part_mentions(spark, d)
    canonical, coref, _ = resolve.resolve_entities(m.drop("mid", "norm"), high=0.62)
    roots = canonical.select(F.col("id").alias("canonical_id"), F.element_at("members", 1).alias("root"))
    return coref.join(roots, "canonical_id").select("mid", "root")


def context_snippet(spark: SparkSession, d: str) -> DataFrame:
    at = (F.instr("text", "on") - 1).cast("int")
    m = F.array(F.struct(at.alias("start"), (at + 2).alias("end"), F.lit(0).alias("sent_id")))
    return table(spark, d, "documents").where(at >= 0).select("doc_id", F.md5(resolve.snippet(F.col("text"), m)).alias("snippet_md5"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    te = reduce.beta_posterior(_evidence(spark, d))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    canonical = c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("Person").alias("type"), F.col("c_name").alias("name"), F.array("c_name", "n_name").alias("aliases"))
    o = table(spark, d, "orders")
    rels = o.select(
        (F.col("o_custkey")).cast("string").alias("head"), (F.col("o_orderkey") % 2000).cast("string").alias("tail"), F.lower("o_orderstatus").alias("type"),
        F.col("o_orderpriority").alias("source_label"), F.lit(0.7).alias("confidence_local")
    )
    nodes = graph.graph_nodes(canonical, te)
    return nodes, graph.graph_edges(nodes, rels, te)


def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0]


def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


def chunks_hold(spark: SparkSession, d: str) -> DataFrame:
    """What must be true of every document's chunks: numbers from 0, each its part of the text, in order, at most 1,500 characters where the text can be cut, and all but white space is in one."""
    docs = table(spark, d, "documents").select(F.col("doc_id"), "text")
    c = F.struct("chunk_no", "true_start", F.length("text").alias("n"), "text")
    lists = chunking.split_documents(docs).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(c)).alias("c"))
    end = lambda x: x["true_start"] + x["n"]
    pairs = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    gap = lambda p: F.when(end(p["x"]) < p["y"]["true_start"], F.substring(F.col("text"), end(p["x"]) + 1, p["y"]["true_start"] - end(p["x"]))).otherwise("")
    last = F.element_at("c", -1)
    edges = F.concat(F.substring(F.col("text"), F.lit(1), F.col("c")[0]["true_start"]), F.substring(F.col("text"), end(last) + 1, F.length("text")))
    blank = lambda t: ~t.rlike(r"(?U)[^\s\x1c-\x1f]")
    true = lambda x: F.when(F.col("c").isNull(), True).otherwise(x)
    return docs.join(lists, "doc_id", "left").select(
        "doc_id", F.col("c").isNotNull().alias("has_chunks"),
        true(F.forall(F.transform("c", lambda x, i: x["chunk_no"] == i), lambda x: x)).alias("numbered"),
        true(F.forall("c", lambda x: F.substring(F.col("text"), x["true_start"] + 1, x["n"]) == x["text"])).alias("in_text"),
        true(F.forall(pairs, lambda p: (p["x"]["true_start"] < p["y"]["true_start"]) & (end(p["x"]) < end(p["y"])))).alias("in_order"),
        true(F.forall("c", lambda x: x["n"] <= chunking.SIZE)).alias("sized"),
        true(F.forall(pairs, lambda p: blank(gap(p))) & blank(edges)).alias("whole"),
    )


def pipeline_e2e(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return run_pipeline(docs)["edges"]


def pipeline_holds(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of the whole pipeline's tables break a rule that must hold between them."""
    t = run_pipeline(table(spark, d, "documents").select("doc_id", "text"))
    mid = t["entities"].select(F.concat_ws(":", "chunk_id", "id").alias("mid"))
    ids, nodes = t["entities_canonical"].select("id"), t["nodes"].select("id")
    number = F.substring("id", 5, 20).cast("long")
    ends = lambda df, a, b: df.select(F.explode(F.array(a, b)).alias("id"))
    broken = {
        "chunk ids repeat": t["chunks"].groupBy("chunk_id").count().where("count > 1"), "coref without entity": t["coref"].join(mid, "mid", "left_anti"),
        "entity without coref": mid.join(t["coref"], "mid", "left_anti"),
        "entity ids not consecutive": ids.agg(F.count_distinct("id").alias("n"), F.max(number).alias("top"), F.count("id").alias("m")).where("m > 0 and (n != m or top != n - 1)"),
        "relation end unknown": ends(t["relations_fused"], "head", "tail").join(ids, "id", "left_anti"), "edge end unknown": ends(t["edges"], "src", "dst").join(nodes, "id", "left_anti"),
        "score out of range": t["trait_edges"].where("not (score between 0 and 1 and confidence between 0 and 1)"), "rows failed": t["errors"],
    }
    counts = [df.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(rule).alias("rule"), "broken") for rule, df in broken.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


QUERIES = {f.__name__: f for f in (
    trait_beta, trait_topk, calibrate_clamp, sentence_index, sentence_windows, person_windows, chunk_offsets, recursive_chunks, json_entities, slug_labels, relation_lookup, span_clip, entity_table, relation_fuse,
    event_fuse, name_normalize, name_normalize_texts, exact_merge, canonical_names, band_pairs, name_similarity, sim_route, entity_clusters, context_snippet, kg_nodes, kg_edges, chunks_hold, pipeline_e2e, pipeline_holds,
)}

ORACLES = {
    "trait_beta": f"WITH {BETA} SELECT person, trait, round(score, 6) AS score, round(confidence, 6) AS confidence, CASE WHEN score >= 0.65 AND confidence >= 0.6 THEN 'HAS_TRAIT' ELSE 'CANDIDATE_TRAIT' END AS label, n AS n_evidence FROM te",
    "trait_topk": f"WITH {EVIDENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY person, trait ORDER BY s * c DESC, event_id) AS rank FROM ev) SELECT person, trait, rank, event_id, round(s * c, 6) AS weight FROM r WHERE rank <= 3",
    "calibrate_clamp": "SELECT event_id, 'k' AS trait, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(json_extract(props, '$.k') AS DOUBLE) / 50 - 0.2::DOUBLE)), 6) AS s, round(0.63::DOUBLE, 6) AS c FROM events",
    "sentence_index": f"WITH {SENTENCES} SELECT doc_id, sent_id, b, e FROM sent",
    "sentence_windows": f"WITH {SENTENCES}, w AS (SELECT doc_id, sent_id, min(b) OVER x AS b, max(e) OVER x AS e, count(*) OVER x AS n_sents FROM sent WINDOW x AS (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT w.*, md5(substr(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT))) AS window_md5 FROM w JOIN documents USING (doc_id)",
    "person_windows": f"""WITH {SENTENCES}, p AS (SELECT doc_id, lang, string_split(text, 'th') AS l FROM documents WHERE instr(text, 'th') > 0),
u AS (SELECT doc_id, lang, unnest(range(1, len(l))) AS k, unnest(l[:-2]) AS part FROM p),
m AS (SELECT DISTINCT doc_id, lang, CAST(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY k) - 2 AS BIGINT) AS pos FROM u),
c AS (SELECT DISTINCT doc_id, lang, sent_id AS sid FROM (SELECT doc_id, lang, pos, max(sent_id) AS sent_id FROM m JOIN sent USING (doc_id) WHERE b <= pos GROUP BY ALL)),
w AS (SELECT c.doc_id, lang, sid, min(b) AS b, max(e) AS e FROM c JOIN sent ON sent.doc_id = c.doc_id AND sent_id BETWEEN sid - 1 AND sid + 1 GROUP BY ALL)
SELECT 'd' || doc_id AS chunk_id, 'p' || w.lang AS canonical_id, sid AS sent_id, b, e, md5(substr(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT))) AS window_md5 FROM w JOIN documents USING (doc_id)""",
    "chunk_offsets": """WITH RECURSIVE c AS (SELECT conv_id, turn, CAST(length(coalesce(text, '')) AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, CAST(0 AS BIGINT) AS b, n AS e FROM c WHERE k = 1 UNION ALL SELECT c.conv_id, c.turn, c.k, greatest(0, r.e - 150), greatest(0, r.e - 150) + c.n FROM r JOIN c ON c.conv_id = r.conv_id AND c.k = r.k + 1)
SELECT conv_id, turn, b, e FROM r""",
    "json_entities": "WITH k AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, event_id || '_e0' AS id, 'Concept' AS type, event_type AS name, k - 10 AS b, CAST(1 AS BIGINT) AS n_mentions FROM k WHERE k - 10 >= 0 AND k <= 60",
    "slug_labels": "SELECT p_partkey, trim(regexp_replace(lower(p_type || ' - ' || p_brand || ' - Café!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, 'involved_in' AS fallback FROM part",
    "relation_lookup": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, trim(o_orderpriority) AS lab, CASE WHEN o_orderkey % 3 = 0 THEN trim(o_orderpriority) ELSE o_orderstatus END AS t FROM orders
WHERE o_custkey % 100 < 60 AND o_orderkey % 70 < 60 AND o_orderkey % 7 <> 0 AND least(20, o_custkey % 30) > 0 AND o_orderkey % 11 <> 0)
SELECT 'c_' || (k % 50) || '_rel_' || (row_number() OVER (PARTITION BY k % 50 ORDER BY k) - 1) AS id, trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_') AS type, 'ent_' || (c % 100) AS head, 'ent_' || (k % 70) AS tail,
'asserted' AS polarity, 'factual' AS modality, 0.7::DOUBLE AS confidence_local, CAST(0 AS BIGINT) AS b, CAST(least(20, c % 30) AS BIGINT) AS e FROM o""",
    "span_clip": """WITH r AS (SELECT d.doc_id, greatest(0, toxic * 600 - 5)::BIGINT AS b, least(length(text), n_chars - 50 + 100 * quality)::BIGINT AS e FROM documents d JOIN labels USING (doc_id))
SELECT doc_id, b, e, b < e AND (doc_id % 2 <> 0 OR (b <= 0 AND 400 <= e)) AS kept FROM r""",
    "entity_table": "SELECT CAST(n_regionkey AS VARCHAR) AS chunk_id, string_agg('e' || n_nationkey || ' : ' || n_name || ' : Location', chr(10) ORDER BY n_nationkey) AS entity_table FROM nation GROUP BY n_regionkey",
    "relation_fuse": """SELECT l_returnflag AS type, 's' || l_suppkey AS head, l_linestatus AS tail, CAST(arg_min(l_linenumber, row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS BIGINT) AS first_line, count(*) AS n_supports,
md5(string_agg(l_orderkey || '-' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS supports_md5, round(greatest(0, max(l_discount * 10)), 6) AS confidence FROM lineitem GROUP BY ALL""",
    "event_fuse": """WITH e AS (SELECT role AS type, 'speaker=' || (conv_id % 5) || ',topic=' || (turn % 3) AS participants, conv_id, turn FROM conversations)
SELECT type, participants, arg_min(conv_id, row(conv_id, turn)) AS first_conv, count(*) AS n_supports, 0.7::DOUBLE AS confidence FROM e GROUP BY type, participants""",
    "name_normalize": r"""WITH n AS (SELECT 'p' || p_partkey AS k, p_name || '_x ' || p_brand AS n FROM part UNION ALL SELECT 'c' || c_custkey, c_name || ' Éßﬁ ' || c_mktsegment FROM customer)
SELECT k, trim(regexp_replace(replace(replace(strip_accents(lower(n)), 'ß', 'ss'), 'ﬁ', 'fi'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS norm FROM n""",
    "exact_merge": """WITH m AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || ':e0' AS b, lang, lower(string_split(text, chr(10))[1]) AS n FROM documents), f AS (SELECT b, min(b) OVER (PARTITION BY lang, n) AS a FROM m) SELECT a, b FROM f WHERE a <> b""",
    "canonical_names": r"""WITH m AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || ':e0' AS mid, regexp_extract(text, '^[A-Za-z]+[^A-Za-z]?') AS name FROM documents),
r AS (SELECT *, min(mid) OVER (PARTITION BY trim(regexp_replace(lower(name), '[^0-9a-z_]+', ' ', 'g'))) AS root FROM m),
f AS (SELECT root, name, count(*) AS n, min(mid) AS first FROM r GROUP BY ALL),
b AS (SELECT root, name FROM f QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, length(name) DESC, first) = 1),
a AS (SELECT root, list_sort(list(DISTINCT name)) AS aliases, count(*) AS n_members FROM r GROUP BY root)
SELECT 'ent_' || (row_number() OVER (ORDER BY root) - 1) AS id, name, array_to_string(aliases, '|') AS aliases, n_members, root FROM a JOIN b USING (root)""",
    "band_pairs": "WITH n AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^0-9a-z_]+', ' ', 'g')) AS n FROM part) SELECT a.n AS a, b.n AS b FROM n a JOIN n b ON substr(a.n, 1, 1) = substr(b.n, 1, 1) AND a.n < b.n WHERE a.n <> ''",
    "name_similarity": f"WITH RECURSIVE {LCS} SELECT a, b, round(sim, 6) AS sim FROM sim",
    "sim_route": f"WITH RECURSIVE {LCS} SELECT a, b, CASE WHEN sim >= 0.93 THEN 'merge' WHEN sim <= 0.4 THEN 'reject' ELSE 'ambiguous' END AS route FROM sim",
    "entity_clusters": f"""WITH RECURSIVE {LCS}, m AS (SELECT 'c:' || lpad(CAST(min(p_partkey) AS VARCHAR), 9, '0') AS mid, trim(regexp_replace(lower(p_name), '[^0-9a-z_]+', ' ', 'g')) AS n FROM part GROUP BY p_name),
e AS (SELECT x.mid AS a, y.mid AS b FROM sim JOIN m x ON x.n = sim.a JOIN m y ON y.n = sim.b WHERE sim >= 0.62 UNION SELECT x.mid, y.mid FROM m x JOIN m y ON x.n = y.n),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT mid AS v, mid AS w FROM m UNION SELECT v, s.b FROM reach JOIN s ON s.a = w) SELECT v AS mid, min(w) AS root FROM reach GROUP BY v""",
    "context_snippet": "WITH m AS (SELECT doc_id, text, instr(text, 'on') - 1 AS s FROM documents WHERE instr(text, 'on') > 0), w AS (SELECT doc_id, text, greatest(0, s - 80) AS b, least(length(text), s + 82) AS e FROM m) SELECT doc_id, md5(trim(replace(substr(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT)), chr(10), ' '))) AS snippet_md5 FROM w",
    "kg_nodes": f"WITH {BETA} SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS label, 'Person' AS \"group\", 'Aliases: ' || c_name || ', ' || n_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT DISTINCT 'trait::' || trait, trait, 'Trait', NULL FROM te",
    "kg_edges": f"""WITH {BETA}, p AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT CAST(o_custkey AS VARCHAR) AS src, CAST(o_orderkey % 2000 AS VARCHAR) AS dst, lower(o_orderstatus) AS label, 'surface: ' || o_orderpriority || chr(10) || 'conf: 0.70' AS title, '#8899ff' AS color, 'relation' AS kind, NULL AS trait_label
FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT id FROM p) AND CAST(o_orderkey % 2000 AS VARCHAR) IN (SELECT id FROM p)
UNION ALL SELECT person, 'trait::' || trait, format('{{:.2f}}/{{:.2f}}', score, confidence), 'n_evidence: ' || n, '#33aa66', 'trait',
CASE WHEN score >= 0.65 AND confidence >= 0.6 THEN 'HAS_TRAIT' ELSE 'CANDIDATE_TRAIT' END FROM te WHERE person IN (SELECT id FROM p)""",
    "chunks_hold": "SELECT doc_id, length(text) > 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AS has_chunks, true AS numbered, true AS in_text, true AS in_order, true AS sized, true AS whole FROM documents",
    "pipeline_holds": "SELECT unnest(['chunk ids repeat', 'coref without entity', 'entity without coref', 'entity ids not consecutive', 'relation end unknown', 'edge end unknown', 'score out of range', 'rows failed']) AS rule, CAST(0 AS BIGINT) AS broken",
}
