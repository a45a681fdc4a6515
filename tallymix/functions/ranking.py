"""Positions in a global order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.functions.sizing import checkpointed


def with_position(df: DataFrame, order: Sequence[Column], into: str) -> DataFrame:
    """1-based position of each row in a global order.

    A range-partitioned sort is stored once; a row's position is its place in its
    partition plus the sizes of the partitions before it.
    """
    stored = checkpointed(df.orderBy(*order)).withColumn("__id", F.monotonically_increasing_id())
    stored = stored.withColumns(
        {
            "__part": F.shiftright("__id", 33),
            "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = stored.groupBy("__part").agg(F.count("*").alias("size"))
    stored = stored.withColumn(
        "__sizes", sizes.agg(F.collect_list(F.struct("__part", "size"))).scalar()
    )
    before = F.aggregate(
        F.filter("__sizes", lambda s: s["__part"] < F.col("__part")),
        F.lit(0).cast("long"),
        lambda acc, s: acc + s["size"],
    )
    position = (F.col("__place") + before + 1).cast("int")
    return stored.withColumn(into, position).drop("__id", "__part", "__place", "__sizes")
