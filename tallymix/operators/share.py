"""Counts and shares of a category."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymix.functions.expressions import n_distinct, only_levels
from tallymix.functions.ranking import with_position


def count_by(
    df: DataFrame, keys: Sequence[str], name: str = "n", distinct_id: str | None = None
) -> DataFrame:
    """Rows per key combination, or distinct entities if an id is given."""
    n = n_distinct(distinct_id) if distinct_id else F.count("*")
    return df.groupBy(*keys).agg(n.alias(name))


def share_within(
    counts: DataFrame, parent: Sequence[str] = (), n: str = "n", name: str = "share", scale: float = 1.0
) -> DataFrame:
    """Each count over the sum of its parent group (or of all), times ``scale``.

    Works on the counts, never on the rows behind them. Without a parent the total is
    a scalar subquery that reuses the exchange of the counts.
    """
    if parent:
        total = F.sum(n).over(Window.partitionBy(*parent))
    else:
        total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn(name, F.col(n) / total * F.lit(float(scale)))


def composition(
    df: DataFrame,
    category: str,
    within: Sequence[str] = (),
    scale: float = 1.0,
    distinct_id: str | None = None,
    n: str = "n",
    name: str = "share",
    total: str | None = None,
) -> DataFrame:
    """The mix of a category inside each parent group."""
    counts = count_by(df, [*within, category], n, distinct_id)
    out = share_within(counts, within, n, name, scale)
    if total:
        whole = F.sum(n).over(Window.partitionBy(*within)) if within else counts.agg(F.sum(n)).scalar()
        out = out.withColumn(total, whole)
    return out


#: Levels that fit into a 64-bit mask beside NULL.
MASK_LEVELS = 62


def share_of_distinct(
    df: DataFrame,
    category: str,
    entity: str,
    levels: Sequence[str] | None = None,
    n: str = "n",
    name: str = "share",
) -> DataFrame:
    """Distinct entities per category over all distinct entities; may sum above 1.

    With closed ``levels`` a value outside them raises, however many they are. Up to
    ``MASK_LEVELS`` of them each entity is folded to one bit mask of the levels it was seen
    with: one scan and one shuffle of entities give all counts and the total. Otherwise
    the total is a second, single-column distinct count.
    """
    if levels is not None and len(levels) > MASK_LEVELS:
        df, levels = df.withColumn(category, only_levels(category, levels)), None
    if levels is None:
        per = df.groupBy(category).agg(n_distinct(entity).alias(n))
        return per.withColumn(name, F.col(n) / df.agg(n_distinct(entity)).scalar())
    slots = [*levels, None]
    bit = reduce(
        lambda acc, kv: acc.when(F.col(category) == kv[1], F.lit(1 << kv[0]).cast("long")),
        enumerate(levels),
        F.when(F.col(category).isNull(), F.lit(1 << len(levels)).cast("long")),
    ).otherwise(
        F.raise_error(F.concat(F.lit(f"{category} outside the given levels: "), F.col(category))).cast("long")
    )
    masks = df.groupBy(entity).agg(F.bit_or(bit).alias("__mask"))
    one = masks.agg(
        F.count("*").alias("__total"),
        *[
            F.count_if(F.col("__mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias(f"__{i}")
            for i in range(len(slots))
        ],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(v).cast("string").alias(category), F.col(f"__{i}").alias(n))
            for i, v in enumerate(slots)
        ]
    )
    return (
        one.select("__total", F.inline(pairs))
        .filter(F.col(n) > 0)
        .select(category, n, (F.col(n) / F.col("__total")).alias(name))
    )


def group_order(
    shares: DataFrame, group: str, category: str, level: str, share: str = "share"
) -> DataFrame:
    """Groups ranked by their share of one category, largest first (ties by name)."""
    slice_ = shares.filter(F.col(category) == level).select(group, share)
    return with_position(slice_, [F.col(share).desc(), F.col(group).asc()], "position")
