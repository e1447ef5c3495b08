"""Row numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

_BITS = 33  # of a monotonically increasing id, below which is the place within a partition


def ranks(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with its rows' numbers, from 1, in the order of any keys; rows with equal keys are numbered in any order.

    The table is sorted by ranges and written; the sizes of the ranges, one number for each partition, give every range its first number.
    Equal keys stand in one range, so order by something that tells rows apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(ranged, "ranges").withColumns({"__part": F.shiftright("__at", _BITS), "__at": F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1))})
    starts, total = [], 0
    for part, count in sorted(tuple(r) for r in placed.groupBy("__part").count().collect()):
        starts.append((part, total + 1))
        total += count
    first = df.sparkSession.createDataFrame(starts, "__part long, __first long")
    joined = placed.join(F.broadcast(first), "__part")  # one row for each partition
    return joined.withColumn(name, F.col("__at") + F.col("__first")).drop("__part", "__at", "__first")
