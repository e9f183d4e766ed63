"""Document fingerprints: a Merkle tree over paragraphs and sections.

Paragraphs are lines, and within a line the pieces after each sentence end. Leaves are paragraphs of LONG characters at most, and
of longer ones the runs of tokens up to each whose hash is less than those of the NEAR tokens before and after it, or to the end
of a run of equal ones: such cuts follow the content, so what an edit leaves alone keeps its leaves. A paragraph hashes its leaves, a section SECTION paragraphs, the root the sections. Equal roots
mean equal texts; where roots differ, differing sections, paragraphs and leaves locate the edit. DataFrame functions only.
A long run without such a token stays one leaf: one word without end, or few words over and over in turn.

Null texts count as empty: one empty leaf. Rows with equal id and text are one document in the order of ids, and each
gets the result. Null ids come last in the descending order; equal ids with other texts follow by the text's hash.
An empty table gives an empty result; one document alone is its own next. A very long text is one row of many leaves. Only the id and the
text are read, so no other column's name can clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, id_key, text_or_empty

SECTION = 16
#: Cuts after a newline, or after a sentence end and the space behind it; nothing of the text is lost.
CUT = r"(?<=\n)|(?<=[.!?] )|(?<=[。！？｡।॥۔።])"
#: Tokens end after anything but letters, marks and digits, and after each letter of scripts that put no space between words.
TOKEN = r"(?<=[^\p{L}\p{M}\p{N}])|(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
LONG, NEAR = 200, 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shorter(piece: Column) -> Column:
    """The leaves of a long paragraph."""

    def leaves(tokens: Column) -> Column:
        last = F.size(tokens) - 1
        least = lambda part: F.coalesce(F.array_min(part), F.lit(2**63 - 1))
        near = lambda h, i: F.least(least(F.slice(h, F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR)))), least(F.slice(h, i + 2, F.lit(NEAR))))
        run_ends = lambda h, i: (i > 0) & (F.get(h, i) == F.get(h, i - 1)) & (F.get(h, i) != F.get(h, i + 1))
        ends = _let(F.transform(tokens, lambda x: F.xxhash64(x)), lambda h: F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(h, i) < near(h, i)) | run_ends(h, i)))
        before = lambda e, k: F.when(k == 0, F.lit(-1)).otherwise(F.get(e, k - 1))
        return _let(ends, lambda e: F.transform(e, lambda x, k: F.array_join(F.slice(tokens, before(e, k) + 2, x - before(e, k)), "")))

    return _let(F.split(piece, TOKEN, -1), leaves)


def with_tree(df: DataFrame, text: str, p: str) -> DataFrame:
    """Adds {p}leaves and {p}paragraphs (array<long>), {p}sections (array<string>) and {p}root (string)."""
    df = df.withColumn(f"{p}pieces", F.split(text, CUT, -1))
    df = df.withColumn(f"{p}parts", F.transform(f"{p}pieces", lambda x: F.when(F.length(x) > LONG, shorter(x)).otherwise(F.array(x))))
    df = df.withColumn(f"{p}leaves", F.transform(F.flatten(f"{p}parts"), lambda x: F.xxhash64(x)))
    df = df.withColumn(f"{p}paragraphs", F.transform(f"{p}pieces", lambda x: F.xxhash64(x)))
    digests = F.transform(f"{p}parts", lambda a: F.when(F.size(a) == 1, F.md5(F.get(a, F.lit(0)))).otherwise(F.md5(F.array_join(F.transform(a, lambda x: F.md5(x)), ""))))
    df = df.withColumn(f"{p}d", digests)
    ends = F.sequence(F.lit(0), F.floor((F.size(f"{p}d") - 1) / SECTION).cast("int"))
    df = df.withColumn(f"{p}sections", F.transform(ends, lambda i: F.md5(F.array_join(F.slice(f"{p}d", i * SECTION + 1, F.lit(SECTION)), ""))))
    df = df.withColumn(f"{p}root", F.sha2(F.concat_ws(":", F.size(f"{p}d").cast("string"), F.array_join(f"{p}sections", "")), 256))
    return df.drop(f"{p}pieces", f"{p}parts", f"{p}d")


def likeness(a: Column, b: Column) -> Column:
    """2 * |leaves in both| / (|leaves of a| + |leaves of b|), each leaf once: 1 for equal trees, 0 for nothing shared."""
    both = F.size(F.array_intersect(a, b)) * 2.0
    return both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def differs(x: Column, y: Column) -> Callable[[Column], Column]:
    return lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i))


def first_leaf(a: Column, b: Column) -> Column:
    """The index of the first leaf in which two trees differ; null if none does."""
    return F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), differs(a, b)), F.lit(0))


def first_edit(sections_a: Column, paragraphs_a: Column, sections_b: Column, paragraphs_b: Column) -> Column:
    """The index of the first paragraph in which two trees differ, found below the first differing section; null if none does."""
    n = F.greatest(F.size(sections_a), F.size(sections_b))
    section = F.get(F.filter(F.sequence(F.lit(0), n - 1), differs(sections_a, sections_b)), F.lit(0))
    return F.get(F.filter(F.sequence(section * SECTION, section * SECTION + SECTION - 1), differs(paragraphs_a, paragraphs_b)), F.lit(0))


def following(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """For each document (_id, _th) the one that it follows in descending order of ids: (_id, _th, _for_id, _for_th, _for_n).

    Ranges of ids are sorted apart, and one row per range links a range to the next: no task sees all rows. The ranges
    are checkpointed, as drawing them anew could cut elsewhere.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = docs.select(id_key(doc_id).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_th"), F.length(text_or_empty(text)).alias("_n")).distinct()
    order = [F.col("_id").desc(), F.col("_th")]
    ranged = cut(keys.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    me = F.struct("_id", "_th", "_n")
    rows = Window.partitionBy("_part").orderBy(*order)
    inside = ranged.withColumn("_before", F.lag(me).over(rows))
    last = ranged.groupBy("_part").agg(F.max_by(me, F.struct(-F.col("_id").cast("decimal(20,0)"), "_th")).alias("_last"))
    chain = Window.partitionBy(F.lit(0)).orderBy("_part")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    link = last.select("_part", F.coalesce(F.lag("_last").over(chain), F.last("_last").over(whole)).alias("_link"))
    out = inside.join(link, "_part").withColumn("_before", F.coalesce("_before", "_link"))
    return out.select("_id", "_th", F.col("_before._id").alias("_for_id"), F.col("_before._th").alias("_for_th"), F.col("_before._n").alias("_for_n"))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they and the next document's are.

    The text is dealt once, by document; of each text only the head that its neighbour's edit takes moves on. Trees are built
    once and written down without the texts; the leaf hashes then go to the neighbour.
    """
    # Both sides of the join read this one exchange: the id comes back from its key, so that their columns are the same.
    base = docs.select(text_or_empty(text).alias("_text"), id_key(doc_id).alias("_id"))
    base = base.withColumn("_th", F.xxhash64("_text"))
    link = following(docs, doc_id, text)
    moved = base.join(link, ["_id", "_th"])
    # Repeated rows give their head once.
    moved = moved.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id"))).where("_nth = 1")
    heads = moved.select(F.col("_for_id").alias("_id"), F.col("_for_th").alias("_th"), F.expr("substring(_text, 1, cast(floor(_for_n / 3) as int))").alias("_head"))
    both = with_tree(base.join(heads, ["_id", "_th"]).withColumn("n_chars", F.length("_text").cast("long")), "_text", "o_")
    both = both.withColumn("doc_id", F.when(F.col("_id") != NULL_ID, F.col("_id")).cast(docs.schema[doc_id].dataType))
    both = both.withColumn("_edited", F.concat(F.expr("substring(_text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.col("_head")))
    both = with_tree(both, "_edited", "e_")
    like = lambda a, b, x, y: F.when(F.col(x) == F.col(y), F.lit(1.0)).otherwise(likeness(F.col(a), F.col(b)))
    told = cut(both.select(
        "_id", "_th", "o_leaves", "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), F.col("o_root").alias("fingerprint"),
        F.col("e_root").alias("edited_fingerprint"), like("o_leaves", "e_leaves", "o_root", "e_root").alias("near_edited"),
        F.size("o_paragraphs").cast("long").alias("n_paragraphs"), F.size("o_sections").cast("long").alias("n_sections"),
        first_edit(F.col("o_sections"), F.col("o_paragraphs"), F.col("e_sections"), F.col("e_paragraphs")).alias("edit_paragraph"),
        F.size("o_leaves").cast("long").alias("n_leaves"), first_leaf(F.col("o_leaves"), F.col("e_leaves")).alias("edit_leaf"),
    ))
    trees = told.groupBy("_id", "_th").agg(F.first("o_leaves").alias("_leaves"), F.first("fingerprint").alias("_root"))
    nexts = trees.join(link, ["_id", "_th"]).select(F.col("_for_id").alias("_id"), F.col("_for_th").alias("_th"), "_leaves", "_root")
    return told.join(nexts, ["_id", "_th"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", like("o_leaves", "_leaves", "fingerprint", "_root").alias("near_next"),
        "n_paragraphs", "n_sections", "edit_paragraph", "n_leaves", "edit_leaf",
    )
