"""The order of a whole table as numbers, with no task that holds the table.

A window over all rows sorts them in one task.  Here rows are dealt by ranges of
the sort key, each range is sorted by its own task, and what comes before a range
is the sum of the counts of the ranges before it: one number for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.shared import keep

_WITHIN = (1 << 33) - 1  # monotonically_increasing_id counts a partition's rows in these bits


def positions(df: DataFrame, order: list[Column | str], name: str = "position", kept=keep) -> DataFrame:
    """``df`` with ``name``: 0 for the first row by ``order``, and so on without gaps.

    Rows of equal keys are numbered in some order and share a range; end ``order``
    with a column that tells them apart where many are equal.  The sorted table is
    written once by ``kept``, as ranges that are drawn anew could differ.  The offsets
    are one row for each range, which bounds the broadcast and the only window.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = kept(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return table.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")
