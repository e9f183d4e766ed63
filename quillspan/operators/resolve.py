"""Entity resolution across chunks.

Mentions are merged if their normalised names are equal inside a type; further pairs come from blocks (type, first character),
are scored, and merged, rejected or put to a backend. As no pair depends on an earlier merge, the classes are the connected
components of one edge set. A class is known by its least mention id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..backends import Backend, ask, prompt, settled
from ..functions.text import name_similarity, normalize_name, token_jaccard, tokens, trim_ws
from ..session import cut
from .components import components
from .numbering import numbered

HIGH, LOW, ACCEPT, CONTEXT = 0.93, 0.40, 0.6, 80
ENTITY_COLUMNS = {"chunk_id": "string", "id": "string", "type": "string", "name": "string"}


def check_columns(entities: DataFrame) -> None:
    """Whether a table is one of entities; raises ValueError for a column that is missing or of another type."""
    types = dict(entities.dtypes)
    for name, kind in ENTITY_COLUMNS.items():
        if types.get(name) != kind:
            raise ValueError(f"entities: {name} must be {kind}, not {types.get(name, 'missing')}")


def mentions_of(entities: DataFrame, norm: Column | None = None) -> DataFrame:
    """Entities with mid (unique over all chunks) and norm."""
    return entities.withColumn("mid", F.concat_ws(":", "chunk_id", "id")).withColumn("norm", normalize_name("name") if norm is None else norm)


def exact_edges(mentions: DataFrame, merge_empty: bool = True) -> DataFrame:
    """(a, b): each mention to the least one with its type and normalised name. Empty names are equal too, unless told otherwise."""
    first = mentions.groupBy("type", "norm").agg(F.min("mid").alias("a"))
    out = mentions.join(first, ["type", "norm"]).where("a != mid")
    return (out if merge_empty else out.where("norm != ''")).select("a", F.col("mid").alias("b"))


def band_pairs(mentions: DataFrame, salts: int = 8) -> DataFrame:
    """(type, a_norm, b_norm): pairs of distinct names of a block, each once. Mentions of one name are merged beforehand, so names are paired and not mentions.

    All pairs of a block are what is asked for, so their number grows with its square; each block is dealt over `salts` keys.
    candidate_pairs() gives those that can score above 0.40, which is all that resolution needs."""
    names = mentions.where("norm != ''").select("type", "norm", F.substring("norm", 1, 1).alias("band")).distinct()
    a = names.withColumn("salt", F.pmod(F.xxhash64("norm"), F.lit(salts)).cast("int")).withColumnRenamed("norm", "a_norm")
    b = names.select("type", "band", F.col("norm").alias("b_norm"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return a.join(b, ["type", "band", "salt"]).where("a_norm < b_norm").select("type", "a_norm", "b_norm")


def candidate_pairs(mentions: DataFrame, low: float = LOW) -> DataFrame:
    """The pairs of band_pairs() whose similarity may exceed `low`, which must be the LCS's weight 0.4 or more: such names share a word.

    Names meet at shared words, and a pair counts at the first one only. Their Jaccard similarity and lengths bound the score before any LCS is computed."""
    names = mentions.where("norm != ''").select("type", "norm").distinct().withColumn("words", F.array_sort(tokens(F.col("norm"))))
    at = names.select("type", "norm", F.substring("norm", 1, 1).alias("band"), "words", F.explode("words").alias("word"))
    a = at.select("type", "band", "word", F.col("norm").alias("a_norm"), F.col("words").alias("a_words"))
    b = at.select("type", "band", "word", F.col("norm").alias("b_norm"), F.col("words").alias("b_words"))
    first = F.get(F.array_intersect("a_words", "b_words"), F.lit(0)) == F.col("word")
    lengths = F.least(F.length("a_norm"), F.length("b_norm")) / F.greatest(F.length("a_norm"), F.length("b_norm"))
    bound = F.lit(0.6) * token_jaccard(F.col("a_norm"), F.col("b_norm")) + F.lit(0.4) * lengths
    return a.join(b, ["type", "band", "word"]).where((F.col("a_norm") < F.col("b_norm")) & first & (bound > low - 1e-9)).select("type", "a_norm", "b_norm")


def route(pairs: DataFrame, high: float = HIGH, low: float = LOW, lcs: Column | None = None) -> DataFrame:
    """Adds sim and route: merge from `high`, reject up to `low`, else ambiguous."""
    scored = pairs.withColumn("sim", name_similarity(F.col("a_norm"), F.col("b_norm"), lcs))
    return scored.withColumn("route", F.when(F.col("sim") >= high, "merge").when(F.col("sim") <= low, "reject").otherwise("ambiguous"))


def snippet(text: Column, mentions: Column, chars: int = CONTEXT) -> Column:
    """The first mention with `chars` characters on either side, on one line; null without a mention or text."""
    first = F.get(mentions, F.lit(0))
    start = F.greatest(F.lit(0), first["start"] - chars)
    return trim_ws(F.replace(F.substring(text, start + 1, F.least(F.length(text), first["end"] + chars) - start), F.lit("\n"), F.lit(" ")))


def adjudicate(pairs: DataFrame, mentions: DataFrame, chunks: DataFrame | None, backend: Backend, max_retries: int = 3, accept: float = ACCEPT, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a, b) of ambiguous pairs that the backend takes for the same, and errors. A pair of names is asked about once, by its first mentions."""
    first = mentions.groupBy("type", "norm").agg(F.min_by(F.struct("mid", "name", "chunk_id", "mentions"), "mid").alias("m"))
    side = lambda p: first.select("type", F.col("norm").alias(f"{p}_norm"), F.col("m").alias(f"{p}_m"))
    rows = pairs.select("type", "a_norm", "b_norm").join(side("a"), ["type", "a_norm"]).join(side("b"), ["type", "b_norm"])
    for p in "ab":
        if chunks is None:
            rows = rows.withColumn(f"{p}_context", F.lit(None).cast("string"))
        else:
            texts = chunks.select(F.col("chunk_id").alias(f"{p}_chunk"), F.col("text").alias(f"{p}_text"))
            rows = rows.join(texts, F.col(f"{p}_m.chunk_id") == F.col(f"{p}_chunk"), "left").withColumn(f"{p}_context", snippet(F.col(f"{p}_text"), F.col(f"{p}_m.mentions")))
    rows = rows.select("type", *[F.col(f"{p}_m.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("mid", "name")], "a_context", "b_context")

    def build(r: dict) -> tuple[str, str]:
        return prompt("same", type=r["type"], **{p: {"name": r[f"{p}_name"], "aliases": [r[f"{p}_name"]], "context": r[f"{p}_context"]} for p in "ab"})

    def check(reply: str, row: dict) -> str | None:
        import json

        try:
            d = json.loads(reply[reply.index("{") : reply.rindex("}") + 1])
            return None if isinstance(d.get("same"), bool) and 0 <= float(d["confidence"]) <= 1 else "bad decision"
        except (ValueError, KeyError, TypeError) as e:
            return f"malformed: {e}"

    asked, errors = settled(ask(rows, backend, build, check, max_retries + 1), "resolution", F.concat_ws(" ", "a_mid", "b_mid"), strict)
    d = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), "struct<same:boolean,confidence:double,rationale:string>")
    # A pair without an accepted reply stays apart.
    same = asked.where("failure is null").withColumn("d", d).where(F.col("d.same") & (F.col("d.confidence") >= accept))
    return same.select(F.col("a_mid").alias("a"), F.col("b_mid").alias("b")), errors


def canonical_entities(mentions: DataFrame, edges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(entities_canonical, coref): id, type, name, aliases, members; and mid, canonical_id.

    The name of a class is its most frequent one, then the longest, then the earliest. Ids are ranks of the least members in
    string order, told range by range.
    """
    if edges is not None and edges.limit(1).count():
        rooted = mentions.join(components(edges), F.col("mid") == F.col("v"), "left").withColumn("root", F.coalesce("root", "mid"))
    else:
        rooted = mentions.withColumn("root", F.col("mid"))
    by_name = rooted.groupBy("root", "name").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    best = Window.partitionBy("root").orderBy(F.col("n").desc(), F.length("name").desc(), "first")
    names = by_name.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("root", F.col("name").alias("best"))
    classes = rooted.groupBy("root").agg(F.min_by("type", "mid").alias("type"), F.array_sort(F.collect_set("name")).alias("aliases"), F.array_sort(F.collect_list("mid")).alias("members"))
    ids = numbered(classes.select("root"), "root").select("root", F.concat(F.lit("ent_"), "number").alias("id"))
    canonical = classes.join(names, "root").join(ids, "root").select("id", "type", F.col("best").alias("name"), "aliases", "members")
    coref = rooted.select("mid", "root").join(ids, "root").select("mid", F.col("id").alias("canonical_id"))
    return canonical, coref


def resolve_entities(
    entities: DataFrame, chunks: DataFrame | None = None, backend: Backend | None = None, high: float = HIGH, low: float = LOW, max_retries: int = 3,
    merge_empty: bool = True, strict: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole stage: (entities_canonical, coref, errors). Without a backend ambiguous pairs stay apart; `strict` raises if it fails for one."""
    check_columns(entities)
    mentions = cut(mentions_of(entities))
    edges = exact_edges(mentions, merge_empty)
    pairs = cut(route(candidate_pairs(mentions, low) if low >= 0.4 else band_pairs(mentions), high, low))
    first = mentions.groupBy("type", "norm").agg(F.min("mid").alias("mid"))
    side = lambda p: first.select("type", F.col("norm").alias(f"{p}_norm"), F.col("mid").alias(p))
    edges = edges.union(pairs.where("route = 'merge'").join(side("a"), ["type", "a_norm"]).join(side("b"), ["type", "b_norm"]).select("a", "b"))
    errors = mentions.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in ("stage", "key", "reason", "raw")])
    if backend is not None:
        same, errors = adjudicate(pairs.where("route = 'ambiguous'"), mentions, chunks, backend, max_retries, strict=strict)
        edges = edges.union(same)
    return *canonical_entities(mentions, edges), errors
