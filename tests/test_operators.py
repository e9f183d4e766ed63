"""Hand-computed cases of each operator."""

import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quillspan.backends import ChatBackend, ReplayBackend, RulesBackend, StageFailed, named_key, prompt, prompt_inputs
from quillspan.functions import jsonx, text as tx
from quillspan.operators import chunking, components, extract, graph, reduce, relations, resolve, traits
from quillspan.operators.numbering import numbered
from quillspan.plans.pipeline import run_pipeline
from quillspan.sources.documents import draw_html, read_text_documents, write_gexf, write_graph


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("A b. C d!  E\n\nF  ", [(0, 0, 4), (1, 5, 9), (2, 11, 12), (3, 14, 15)]), ("Mr. Krabs ran.", [(0, 0, 3), (1, 4, 14)]), ("", []), (None, []), (" \n\n \n\n x", [(0, 3, 7)])])
def test_sentences(spark, given, want):
    got = chunking.sentence_index(spark.createDataFrame([(1, given)], "k int, text string"), ["k"]).orderBy("sent_id").collect()
    assert [tuple(r)[1:] for r in got] == want or given == " \n\n \n\n x" and len(got) == 1


def test_offsets(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([1400, 500, 300, 1500, 100])], "d int, i int, n int")
    got = chunking.chunk_offsets(rows, ["d"], "i", "n").orderBy("i").collect()
    assert [r.start_idx for r in got] == [0, 650, 400, 0, 750]
    random.seed(5)
    sizes = [random.randint(1, 1500) for _ in range(200)]
    got = chunking.chunk_offsets(spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "d int, i int, n int"), ["d"], "i", "n").orderBy("i").collect()
    start = 0
    for r, n in zip(got, sizes):
        assert (r.start_idx, r.end_idx) == (start, start + n)
        start = max(0, start + n - chunking.OVERLAP)


def test_split_spans():
    text = "one two three\n\nfour five. six\nseven " * 20
    for size, overlap in ((30, 10), (100, 50), (7, 3)):
        spans = list(chunking.split_spans(text, size, overlap))
        assert all(0 < b - a <= size and text[a:b] == text[a:b].strip() for a, b in spans)
        covered = set().union(*(range(a, b) for a, b in spans))
        assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert list(chunking.split_spans("", 10, 5)) == []
    assert [("abcdefgh"[a:b]) for a, b in chunking.split_spans("abcdefgh", 4, 2)] == ["abcd", "cdef", "efgh"]


def test_json_rules(spark):
    assert one(spark, jsonx.json_slice(F.lit('x {"a":{}} y'))) == '{"a":{}}'
    assert one(spark, jsonx.json_slice(F.lit("} x {"))) is None
    raw = '```{"entities":[{"type":"Org","name":" A ","mentions":[{"start":0,"end":3,"sent_id":0},{"start":2,"end":99,"sent_id":0},{"start":"3","end":4,"sent_id":0}]},{"type":"Org","name":"B","mentions":[]}]}```'
    got = one(spark, jsonx.parse_entities(F.lit(raw), F.lit("abcdef")))
    assert [(e["name"], len(e["mentions"])) for e in got] == [("A", 1)]
    assert not one(spark, jsonx.entities_hold(jsonx.parse_entities(F.lit(raw.replace('"Org","name":" A "', '"Ship","name":"A"')), F.lit("abcdef"))))


@pytest.mark.parametrize("given, want", [("  Works-at: Café! ", "works_at_caf"), ("???", "involved_in"), ("  ", "involved_in"), (None, "involved_in")])
def test_slug(spark, given, want):
    assert one(spark, tx.slug(F.lit(given).cast("string"))) == want


def test_names(spark):
    assert [tx.plain_name(x) for x in ("Élan Straße", "SpongeBob’s", "a_b", "!!!", None)] == ["elan strasse", "spongebob s", "a_b", "", ""]
    cases = [("patrick", "patrick star", 0.533333), ("spongebob", "spongebob squarepants", 0.471429), ("krabby patty", "krabby patties", 0.514286), ("a b c", "a c b", 0.84), ("krusty krab", "karen", 0.072727), ("kitten", "kitting", 0.285714), ("international bank of new york a b", "international bank of new york b a", 0.976471), ("", "x", 0.0)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    native = tx.name_similarity(F.col("a"), F.col("b"), tx.lcs_length(F.col("a"), F.col("b")))
    for how in (native, tx.name_similarity(F.col("a"), F.col("b"))):
        assert [r[0] for r in rows.select(F.round(how, 6)).collect()] == pytest.approx([w for *_, w in cases], abs=1e-4)
    assert (tx._lcs("kitten", "sitting"), tx._lcs("krabby patty", "krabby patties"), tx._lcs("abc", "")) == (4, 11, 0)


def entities(spark, rows):
    return spark.createDataFrame([(c, i, f"{c}_e{i}", t, n, [(0, 1, 0)]) for i, (c, t, n) in enumerate(rows)], "chunk_id string, ord int, id string, type string, name string, mentions array<struct<start:int,end:int,sent_id:int>>")


def test_resolution(spark):
    rows = [("d_0", "Person", "Mr. Krabs"), ("d_0", "Person", "Eugene Krabs"), ("d_1", "Person", "mr krabs"), ("d_1", "Org", "Mr. Krabs"), ("d_0", "Person", "!!!"), ("d_1", "Person", "???"), ("d_0", "Person", "patrick"), ("d_1", "Person", "patrick star")]
    same = ReplayBackend(lambda stage, given: '{"same": true, "confidence": 0.9}')
    canonical, coref, errors = resolve.resolve_entities(entities(spark, rows), None, same)
    assert errors.count() == 0
    classes = {frozenset(int(m.rpartition("e")[2]) for m in r.members) for r in canonical.collect()}
    assert classes == {frozenset({0, 2}), frozenset({1}), frozenset({3}), frozenset({4, 5}), frozenset({6, 7})}
    assert coref.count() == len(rows)
    canonical = resolve.resolve_entities(entities(spark, rows).repartition(7), merge_empty=False)[0]
    assert canonical.count() == 7
    unsure = ReplayBackend(lambda stage, given: '{"same": true, "confidence": 0.5}')
    assert resolve.resolve_entities(entities(spark, rows), None, unsure)[0].count() == 6


def down(stage):
    """A backend that fails in one stage; local, so that workers get it by value."""

    class Down:
        def generate(self, system, user):
            if f"Stage: {stage}." in system:
                raise OSError("down")
            return RulesBackend().generate(system, user)

    return Down()


STORY = "Mr. Harold Finch worked with Ann Perry. Ann Perry helped Ann Perry Jones plan the party.\n\nShe laughed with Harold Finch Stone. Dr. Ann Perry worried. " * 3


@pytest.mark.parametrize("stage, told", [("entities", "entities"), ("same", "resolution"), ("relations", "relations"), ("traits", "traits")])
def test_failures_become_errors_or_raise(spark, stage, told):
    docs = spark.createDataFrame([("a", STORY)], "doc_id string, text string")
    out = run_pipeline(docs, down(stage), size=300, overlap=100)
    errors = out["errors"].collect()
    assert errors and {r.stage for r in errors} == {told} and all("down" in r.reason for r in errors)
    assert run_pipeline(docs, size=300, overlap=100)["errors"].count() == 0
    with pytest.raises(StageFailed, match=told):
        run_pipeline(docs, down(stage), size=300, overlap=100, strict=True)


def test_candidate_pairs_lose_no_score_above_the_bound(spark):
    r = random.Random(3)
    parts = ["ann", "anna", "a", "al", "perry", "pen", "jones", "de", "la", "o"]
    rows = [("d_0", "Person", " ".join(r.choice(parts) for _ in range(r.randint(1, 4)))) for _ in range(80)]
    m = resolve.mentions_of(entities(spark, rows))
    score = lambda df: {(x.a_norm, x.b_norm) for x in resolve.route(df).where("route != 'reject'").collect()}
    every, few = resolve.band_pairs(m), resolve.candidate_pairs(m)
    assert score(every) == score(few) and few.count() == few.distinct().count() < every.count()
    norms = sorted({x.norm for x in m.collect()})
    assert sorted(map(tuple, every.select("a_norm", "b_norm").collect())) == [(x, y) for i, x in enumerate(norms) for y in norms[i + 1 :] if x[0] == y[0]]


def test_events_as_nodes(spark):
    docs = spark.createDataFrame([("a", STORY)], "doc_id string, text string")
    plain, more = (run_pipeline(docs, size=300, overlap=100, with_events=x) for x in (False, True))
    events = {r.id: {(p.role, p.entity_id) for p in r.participants_global} for r in more["events_fused"].collect()}
    assert events and plain["nodes"].where("group = 'Event'").count() == 0
    assert {r.id for r in more["nodes"].where("group = 'Event'").collect()} == set(events)
    told = {}
    for r in more["edges"].where("kind = 'event'").collect():
        told.setdefault(r.src, set()).add((r.label, r.dst))
    assert told == events and more["edges"].where("kind != 'event'").count() == plain["edges"].count()


def test_wrong_tables_and_windows(spark):
    with pytest.raises(ValueError, match="name must be string, not missing"):
        resolve.resolve_entities(spark.createDataFrame([("c", "e", "t")], "chunk_id string, id string, type string"))
    reply = lambda stage, given: '{"entities": [{"type": "Person", "name": "Ann", "mentions": [{"start": 0, "end": 3, "sent_id": 99}]}]}' if stage == "entities" else "{}"
    docs = spark.createDataFrame([("a", "Ann ran.")], "doc_id string, text string")
    assert [(r.stage, r.reason) for r in run_pipeline(docs, ReplayBackend(reply))["errors"].collect()] == [("windows", "no such sentence")]
    with pytest.raises(StageFailed, match="windows"):
        run_pipeline(docs, ReplayBackend(reply), strict=True)


def test_numbers(spark):
    got = {x.v: x.number for x in numbered(spark.range(500).select((F.col("id") * 7 % 500).alias("v")).repartition(6), "v").collect()}
    assert got == {v: v for v in range(500)}
    assert numbered(spark.range(0).withColumnRenamed("id", "v"), "v").count() == 0


def test_sums_before(spark):
    r = random.Random(6)
    rows = [[r.randint(0, 9) for _ in range(n)] for n in (1, 63, 64, 65, 500)]
    got = spark.createDataFrame([(x,) for x in rows], "v array<int>").select("v", chunking.sums_before(F.col("v")).alias("s")).collect()
    assert all(x.s == [sum(x.v[:i]) for i in range(len(x.v))] for x in got)


def test_sentences_of_long_texts(spark):
    text = "".join(f"Sentence {i} is here{'.!?'[i % 3]} " for i in range(4000))
    got = spark.createDataFrame([(1, text)], "k int, text string").select(chunking.sentence_spans(F.col("text")).alias("s")).first().s
    assert [text[x.start : x.end] for x in got] == [f"Sentence {i} is here{'.!?'[i % 3]}" for i in range(4000)]


def test_chunk_places(spark):
    docs = spark.createDataFrame([("a", STORY * 5), ("b", "x" * 40)], "doc_id string, text string")
    chunks = chunking.split_documents(docs, 100, 40)
    by_window = chunking.chunk_offsets(chunks.drop("start_idx", "end_idx"), ["doc_id"], "chunk_no", F.length("text"), 40)
    columns = ["chunk_id", "start_idx", "end_idx"]
    assert sorted(map(tuple, chunks.select(columns).collect())) == sorted(map(tuple, by_window.select(columns).collect()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_extraction(spark):
    chunks = spark.createDataFrame([("c_0", "Ann met Bob", [(0, 0, 11)]), ("c_1", "x", [])], "chunk_id string, text string, sent_index array<struct<sent_id:int,start:int,end:int>>")
    calls = {"c_0": '{"entities": [{"type": "Person", "name": "Ann", "mentions": [{"start": 0, "end": 3, "sent_id": 0}, {"start": 3.0, "end": 4, "sent_id": 0}]}]}', "c_1": "no reply"}
    es, errors = extract.extract_entities(chunks, ReplayBackend(lambda stage, given: calls[given["chunk_id"]]))
    assert [(r.id, len(r.mentions)) for r in es.collect()] == [("c_0_e0", 1)]
    assert [(r.key, r.reason) for r in errors.collect()] == [("c_1", "no JSON object")]
    with pytest.raises(RuntimeError):
        extract.extract_entities(chunks, ReplayBackend(lambda stage, given: "{"), strict=True)
    assert extract.check_entities('{"entities": null}', {"text": "a"}).startswith("malformed")
    assert prompt_inputs(prompt("traits", person="a", text="x\nInput: y")[1]) == {"person": "a", "text": "x\nInput: y"}


def clip(spark, length, span, trigger=None):
    s = F.struct(F.lit(span[0]).alias("start"), F.lit(span[1]).alias("end"), F.lit(0).alias("sent_id"), (F.struct(F.lit(trigger[0]).alias("start"), F.lit(trigger[1]).alias("end")) if trigger else F.lit(None).cast("struct<start:int,end:int>")).alias("trigger"))
    c = relations.clip_spans(F.array(s), F.lit(length))
    r = spark.range(1).select(c[0].alias("s"), relations.spans_hold(c).alias("ok")).first()
    return (r.s.start, r.s.end), r.ok


def test_spans(spark):
    assert clip(spark, 10, (-2, 12)) == ((0, 10), True)
    assert not clip(spark, 10, (10, 12))[1]
    assert clip(spark, 10, (0, 5), (2, 5))[1] and not clip(spark, 10, (0, 5), (2, 6))[1]
    assert one(spark, relations.spans_hold(relations.clip_spans(F.array().cast(f"array<{relations.SUPPORT}>"), F.lit(3))))


def test_relations(spark):
    chunks = spark.createDataFrame([("d_0", "d", 0, "Ann helped Bob")], "chunk_id string, doc_id string, chunk_no int, text string")
    es = entities(spark, [("d_0", "Person", "Ann"), ("d_0", "Person", "Bob")])
    coref = spark.createDataFrame([("d_0:d_0_e0", "ent_0"), ("d_0:d_0_e1", "ent_1")], "mid string, canonical_id string")
    reply = '{"relations": [{"source_label": "Helped!", "head": "d_0_e0", "tail": "d_0_e1", "supports": [{"start": 0, "end": 14, "sent_id": 0}]}, {"source_label": "x", "head": "d_0_e0", "tail": "gone"}, {"head": "d_0_e0", "tail": "d_0_e1"}, {"source_label": "y", "head": "d_0_e1", "tail": "d_0_e0", "confidence_local": 1.2}, {"source_label": "z", "head": "d_0_e1", "tail": "d_0_e0"}], "events": [{"source_label": "help", "participants": [{"role": "agent", "entity_id": "d_0_e0"}, {"role": "x", "entity_id": "?"}]}]}'
    rels, events, errors = relations.extract_relations(chunks, es, coref, ReplayBackend(lambda s, g: reply))
    assert [(r.id, r.type, r.head, r.tail, r.polarity, r.confidence_local) for r in rels.orderBy("id").collect()] == [("d_0_rel_0", "helped", "ent_0", "ent_1", "asserted", 0.7), ("d_0_rel_1", "z", "ent_1", "ent_0", "asserted", 0.7)]
    e = events.first()
    assert (e.id, e.status, [p.entity_id for p in e.participants], [p.entity_id for p in e.participants_global]) == ("d_0_evt_0", "completed", ["d_0_e0", "?"], ["ent_0", "?"])
    assert errors.count() == 0
    assert relations.extract_relations(chunks, es, coref, ReplayBackend(lambda s, g: "{bad}"))[2].count() == 1


def test_windows(spark):
    chunks = spark.createDataFrame([("c", "A. B. C.", [(0, 0, 2), (1, 3, 5), (2, 6, 8)])], "chunk_id string, text string, sent_index array<struct<sent_id:int,start:int,end:int>>")
    people = spark.createDataFrame([("c", "ent_0", "A", "e0", [(0, 1, s) for s in (0, 1, 1, 2, 3, 4)])], "chunk_id string, canonical_id string, display_name string, local_id string, mentions array<struct<start:int,end:int,sent_id:int>>")
    windows, errors = traits.person_windows(people, chunks)
    assert {r.sent_id_center: (r.sent_ids, r.text) for r in windows.collect()} == {0: ([0, 1], "A. B."), 1: ([0, 1, 2], "A. B. C."), 2: ([1, 2], "B. C."), 3: ([2], "C.")}
    assert [r.raw for r in errors.collect()] == ["4"]


def test_traits(spark):
    assert one(spark, traits.calibrate(F.create_map(F.lit("a"), F.lit(1.5), F.lit("b"), F.lit(-0.1), F.lit("c"), F.lit(float("nan"))))) == {"a": 1.0, "b": 0.0, "c": 1.0}
    w = spark.createDataFrame([("c", "ent_0", "A", 0, [0], 10, 20, "text")], "chunk_id string, canonical_id string, display_name string, sent_id_center int, sent_ids array<int>, start int, end int, text string")
    told = '{"trait_probs": {"Openness": 0.9}, "evidence": [{"span": [1, 3], "text": "ex", "neg": true}]}'
    got = traits.extract_traits(w, ReplayBackend(lambda s, g: told))[0].first()
    assert (got.s, round(got.c, 6), got.span.start, got.span.end) == (0.9, 0.63, 11, 13)
    assert round(traits.extract_traits(w, ReplayBackend(lambda s, g: told), use_negation=True)[0].first().s, 6) == 0.1
    assert traits.extract_traits(w, ReplayBackend(lambda s, g: '{"trait_probs": {"Openness": 0.9}, "evidence": []}'))[0].count() == 0


@pytest.mark.parametrize("s, score, conf, label", [([1.0], 0.619772, 0.740325, "C"), ([1.0] * 2, 0.693252, 0.800325, "H"), ([0.84] * 2, 0.631411, 0.781473, "C"), ([0.84] * 3, 0.665193, 0.817823, "H"), ([0.5] * 3, 0.5, 0.795501, "C"), ([0.0], 0.380228, 0.740325, "C")])
def test_beta(spark, s, score, conf, label):
    rows = spark.createDataFrame([("p", "t", float(x), 0.63, i) for i, x in enumerate(s)], "person string, trait string, s double, c double, ord int")
    r = reduce.beta_posterior(rows).first()
    assert (round(r.score, 6), round(r.confidence, 6), r.label[0], r.n_evidence) == (score, conf, label, len(s))


def test_topk_ties(spark):
    rows = spark.createDataFrame([("p", "t", w, 1.0, i, (f"c{i}", i, i + 1)) for i, w in enumerate([1.0, 2.0, 2.0, 0.5], 1)], "person string, trait string, s double, c double, ord int, span struct<chunk_id:string,start:int,end:int>")
    assert [x.chunk_id for x in reduce.beta_posterior(rows).first().topk] == ["c2", "c3", "c1"]


def test_fuse(spark):
    rows = spark.createDataFrame([("t", "a", "b", None, "asserted", 0.7, ["s"], 1), ("t", "a", "b", None, "negated", 0.9, ["s"], 2)], "type string, head string, tail string, time_norm string, polarity string, confidence_local double, supports array<string>, ord int")
    r = reduce.fuse_relations(rows).collect()
    assert [(x.polarity, x.confidence_local, x.supports) for x in r] == [("asserted", 0.9, ["s", "s"])]
    assert reduce.fuse_relations(rows, key_polarity=True).count() == 2
    e = spark.createDataFrame([("t", [("a", "1"), ("b", "2")], None, 0.7, ["x"], 1), ("t", [("b", "2"), ("a", "1")], None, 0.7, ["y"], 2)], "type string, participants array<struct<role:string,entity_id:string>>, time_norm string, confidence_local double, supports array<string>, ord int")
    assert [x.supports for x in reduce.fuse_events(e).collect()] == [["x", "y"]]


def test_graph_and_sinks(spark, tmp_path):
    canonical = spark.createDataFrame([("e0", "Person", "Ann", ["Ann", "A."])], "id string, type string, name string, aliases array<string>")
    te = spark.createDataFrame([("e0", "Openness", 0.7, 0.8, "HAS_TRAIT", 2), ("gone", "Openness", 0.7, 0.8, "CANDIDATE_TRAIT", 2)], "person string, trait string, score double, confidence double, label string, n_evidence long")
    rel = spark.createDataFrame([("e0", "e0", "likes", "Likes", 0.7), ("e0", "e0", "likes", "Likes", 0.7), ("e0", "gone", "x", "X", 0.7)], "head string, tail string, type string, source_label string, confidence_local double")
    nodes = graph.graph_nodes(canonical, te)
    edges = graph.graph_edges(nodes, rel, te)
    assert nodes.count() == 2 and edges.count() == 3
    assert {(r.label, r.title) for r in edges.collect()} == {("likes", "surface: Likes\nconf: 0.70"), ("0.70/0.80", "n_evidence: 2")}
    page = draw_html(nodes, edges, str(tmp_path / "g.html"))
    assert "Ann" in open(page).read()
    with pytest.raises(ValueError):
        draw_html(nodes, edges, str(tmp_path / "g.html"), most=1)
    told = ElementTree.parse(write_gexf(nodes, edges, str(tmp_path / "g.gexf"))).getroot()
    space = {"g": "http://gexf.net/1.3"}
    assert {n.get("label") for n in told.findall(".//g:node", space)} == {"Ann", "Openness"}
    assert sorted((e.get("source"), e.get("target")) for e in told.findall(".//g:edge", space)) == [("e0", "e0"), ("e0", "e0"), ("e0", "trait::Openness")]
    write_graph(nodes, edges, str(tmp_path / "import"), "import")
    rows = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path / "import" / "edges"))
    assert rows.columns[:3] == [":START_ID", ":END_ID", ":TYPE"] and rows.count() == 3
    for fmt in ("parquet", "json", "csv"):
        write_graph(nodes.select("id", "label"), edges, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).options(header="true").load(str(tmp_path / fmt / "nodes")).count() == 2


def test_pipeline(spark, tmp_path):
    (tmp_path / "story.txt").write_text("Mr. Harold Finch worked with Ann Perry. Ann Perry helped Harold Finch plan the party.\r\n\r\nShe laughed with Bob Stone. " * 5)
    docs = read_text_documents(spark, str(tmp_path / "story.txt"))
    assert docs.first().doc_id == "story" and "\r" not in docs.first().text
    out = run_pipeline(docs, RulesBackend(), size=200, overlap=80)
    assert out["edges"].count() > 0 and out["errors"].count() == 0
    assert out["coref"].count() == out["entities"].count()
    empty = run_pipeline(spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string"))
    assert empty["edges"].count() == 0 and empty["nodes"].count() == 0


def test_stream(spark, tmp_path):
    from quillspan.streaming import beta_of_sums, stream_trait_sums

    rows = spark.createDataFrame([("p", "t", 1.0, 0.63), ("p", "t", 1.0, 0.63)], "person string, trait string, s double, c double").withColumn("ts", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "in"))
    q = stream_trait_sums(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sums").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    r = beta_of_sums(spark.table("sums")).orderBy(F.col("n_evidence").desc()).first()
    assert round(r.score, 6) == 0.693252 and r.n_evidence == 2


def test_file_names_and_encodings(spark, tmp_path):
    (tmp_path / "my störy.v1.txt").write_bytes("Größe\r\nx".encode("iso-8859-1"))
    (tmp_path / "plain").write_bytes("Größe\rx".encode("iso-8859-1"))
    assert {r.doc_id: r.text for r in read_text_documents(spark, str(tmp_path), "ISO-8859-1").collect()} == {"my störy.v1": "Größe\nx", "plain": "Größe\nx"}


def test_snippet_loses_white_space(spark):
    m = F.array(F.struct(F.lit(3).alias("start"), F.lit(4).alias("end"), F.lit(0).alias("sent_id")))
    assert one(spark, resolve.snippet(F.lit("\t\n\u2003x y\x1f\t "), m)) == "x y"


def test_chat_settings(tmp_path, monkeypatch):
    for name in ("OPENAI_KEY", "OPENAI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    env = tmp_path / "env"
    env.write_text("# keys\nOTHER=1\nexport OPENAI_KEY='abc'\n")
    assert named_key(str(env)) == "abc" and named_key(str(tmp_path / "none")) is None
    monkeypatch.setenv("OPENAI_KEY", "own")
    assert named_key(str(env)) == "own"
    b = ChatBackend("k", max_tokens=9, response_format=None)
    assert b.settings == {"model": "gpt-4o-mini", "temperature": 0.0, "max_tokens": 9} and b.timeout == 60


def test_command_line(spark, tmp_path, monkeypatch):
    from quillspan import __main__ as cli

    (tmp_path / "a story.txt").write_text(STORY)
    monkeypatch.setattr(cli, "build_session", lambda master: spark)
    cli.main([str(tmp_path / "a story.txt"), "--out", str(tmp_path / "g"), "--format", "json", "--html", str(tmp_path / "g.html")])
    assert spark.read.json(str(tmp_path / "g" / "edges")).count() > 0 and "Harold Finch" in (tmp_path / "g.html").read_text()


def test_stream_of_documents(spark, tmp_path):
    from quillspan.streaming import stream_chunks, stream_entities

    docs = spark.createDataFrame([("a", STORY), ("b", None)], "doc_id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    entities, errors = stream_entities(stream_chunks(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), 300, 100), RulesBackend())
    for name, df in (("streamed", entities), ("failed", errors)):
        df.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(60)
    batch = run_pipeline(docs, size=300, overlap=100)["entities"]
    assert sorted(r.id for r in spark.table("streamed").collect()) == sorted(r.id for r in batch.collect()) != [] and spark.table("failed").count() == 0


def test_shared_folder_is_asked_for(monkeypatch):
    from quillspan import session

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Session())
