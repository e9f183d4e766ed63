"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines is hashed (128 bits: two hashes of each line from different seeds). Of each window's occurrences over all documents the first
by (doc_id, position) stays; the lines that any later one covers go, overlaps merged. DataFrame functions only.

Rows: one per row of the input. Null texts count as empty and stay null; a text of fewer lines than a window is
never changed; null ids come first in the order; rows with equal id and text count as one document and get the same result. An empty table gives an empty result. Texts are never cut: a very
long one is a row of many windows. Input columns may have any name but `_lines`, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, packed, text_or_empty, unpacked


def _windows(keyed: DataFrame, lines: int) -> DataFrame:
    """A row for each window: its two hashes, the document's key and the first line's position."""
    lined = keyed.select("_id", "_th", F.split("text", "\n", -1).alias("l")).where(F.size("l") >= lines)
    lined = lined.select("_id", "_th", F.transform("l", lambda x: F.xxhash64(x)).alias("a"), F.transform("l", lambda x: F.xxhash64(F.lit(1), x)).alias("b"))
    at = F.explode(F.sequence(F.lit(1), F.size("a") - (lines - 1)))
    row = lined.select("_id", "_th", "a", "b", at.alias("p"))
    pick = lambda c: F.xxhash64(*[F.element_at(c, F.col("p") + i) for i in range(lines)])
    return row.select(pick("a").alias("_a"), pick("b").alias("_b"), "_id", "_th", (F.col("p") - 1).alias("_p"))


def dedup_lines(docs: DataFrame, lines: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of `docs`, the text without later occurrences, and a struct `_lines` (n_lines, n_removed)."""
    given = F.col("row").getField(text)
    keyed = packed(docs).withColumns({"_id": id_key(F.col("row").getField(doc_id)), "_th": F.xxhash64(given)})
    windows = _windows(keyed.select("_id", "_th", text_or_empty(given).alias("text")), lines)
    # Counted with map-side sums; only what is found twice is joined back, so a hot window is one row on that side.
    first = windows.groupBy("_a", "_b").agg(F.min(F.struct("_id", "_th", "_p")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    later = windows.join(first, ["_a", "_b"]).where(F.struct("_id", "_th", "_p") != F.col("_first"))
    covered = later.groupBy("_id", "_th").agg(F.collect_set("_p").alias("_starts"))
    out = keyed.join(covered, ["_id", "_th"], "left")
    # Element by element the positions cover `lines` lines each; array_except merges what overlaps.
    every = F.split(text_or_empty(given), "\n", -1)
    gone = F.flatten(F.transform("_starts", lambda p: F.sequence(p, p + (lines - 1))))
    out = out.withColumn("_all", every).withColumn("_keep", F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), gone))
    kept = F.array_join(F.transform("_keep", lambda i: F.element_at(F.col("_all"), i + 1)), "\n")
    changed = F.col("_starts").isNotNull()
    stats = F.struct(F.size("_all").cast("long").alias("n_lines"), F.when(changed, F.size("_all") - F.size("_keep")).otherwise(0).cast("long").alias("n_removed"))
    out = out.withColumn("_lines", stats).withColumn("row", F.col("row").withField(text, F.when(changed, kept).otherwise(given)))
    return unpacked(out, docs.columns, "_lines")
