"""Hashes of large ordered groups, by ranges and then level by level, with no list of a group anywhere.

Rows get their place in the order of (group, key); every ``fan`` neighbours of a group are
hashed together, their hashes again, until one is left.  A group of one row has the hash
of that row, and what is hashed on each level is at most ``fan`` values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.order import positions
from rankloom.functions.shared import keep

FAN = 1024


def tree_hash(rows: DataFrame, group: str, order: list[Column | str], value: str, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """group, n, hash: of each group's ``value`` strings in ``order``, sha-256 in hexadecimal.

    Levels are added until one hash is left.  Where a format fixes the number of ``levels``, the last one is a single node over
    all that is left, n / fan ** (levels - 1) hashes of a group: one digest, and so one task, by that format's nature.
    """
    placed = positions(rows.select(F.col(group).alias("_g"), F.coalesce(F.col(value), F.lit("")).alias("_v"), *[F.col(c) if isinstance(c, str) else c for c in order]), ["_g", *order], "_p")
    first = placed.groupBy("_g").agg(F.min("_p").alias("_first"), F.count("*").alias("n"))
    first = keep(first)
    level = keep(placed.join(first.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "n", (F.col("_p") - F.col("_first")).alias("_p"), F.col("_v").alias("hash")))
    most = first.agg(F.max("n")).first()[0] or 1
    depth = 0
    while most > 1:
        depth += 1
        last = depth == levels
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "hash"))), lambda x: x.hash), ",")
        # a node with one child, which only the last of a group has, is that child
        made = F.when(F.count("*") == 1, F.first("hash")).otherwise(F.sha2(joined, 256))
        level = keep(level.groupBy("_g", "n", (F.lit(0).cast("long") if last else F.floor(F.col("_p") / fan)).alias("_q")).agg(made.alias("hash")).withColumnRenamed("_q", "_p"))
        most = 1 if last else -(-most // fan)
    return level.select(F.col("_g").alias(group), "n", "hash")
