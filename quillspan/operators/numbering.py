"""Consecutive numbers over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds `number`, from 0 in the order of distinct rows of `order`.

    Ranges of rows are sorted apart; one row a range tells how many come before it. The ranges are written down, as drawing them anew could cut elsewhere; release(result._uses) frees them.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # As many rows as there are ranges.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    out = ranged.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn("number", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
    out._uses = ranged
    return out
