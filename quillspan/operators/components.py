"""Connected components of an edge list, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(v, root) for every vertex of an edge; root is the least vertex of its component.

    Each round takes the least label among the neighbours (sums of it are taken before the shuffle, so a hub costs no task
    more), then jumps to the label's label. The label of a vertex only falls, so rounds stop when none does; their number is
    about the logarithm of the longest path. Each round's labels are written to the shared folder and those of the round before
    deleted; the result is such a table, which release() frees. Self-loops and repeated edges change nothing; no edges, no rows.
    """
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("m")).select("v", F.least("v", "m").alias("root"), F.lit(True).alias("fell")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("v").alias("y"), "root"), "y").groupBy(F.col("x").alias("v")).agg(F.min("root").alias("near"))
        low = labels.join(near, "v").select("v", "root", F.least("root", "near").alias("low"))
        up = labels.select(F.col("v").alias("low"), F.col("root").alias("top"))
        new = cut(low.join(up, "low").select("v", F.least("low", "top").alias("root"), (F.least("low", "top") != F.col("root")).alias("fell")))
        release(labels)
        labels = new
        if not labels.where("fell").limit(1).count():
            release(both)
            out = labels.select("v", "root")
            out._cut_path = labels._cut_path
            return out
    raise RuntimeError("components did not settle")
