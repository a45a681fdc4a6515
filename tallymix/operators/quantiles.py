"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tallymix.functions.sizing import null_safe_join, written, written_with

#: Buckets of a histogram per group and pass, as a power of two.
BUCKET_BITS = 12


def bounded_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Quantiles of groups known to be small (at most one row per bootstrap draw).

    Spark's ``percentile`` interpolates between order statistics but buffers a whole
    group, so it is used only where the number of draws bounds the group.
    """
    q = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()])).alias("__q")
    named = [F.col("__q")[i].alias(name) for i, name in enumerate(probs)]
    return df.groupBy(*keys).agg(q).select(*keys, *named)


#: Sort keys of infinity; NaN comes after it.
TOP = 2047 << 52


@F.pandas_udf(LongType())
def sort_key(x: pd.Series) -> pd.Series:
    """A long that orders like the double: its bits, negated below zero.

    Both zeros are 0; infinities lie beyond all finite values and NaN beyond them.
    """
    v = x.to_numpy(dtype=np.float64)
    bits = np.abs(v).view(np.int64)
    return pd.Series(np.where(np.isnan(v), TOP + 1, np.where(v < 0, -bits, bits)))


@F.pandas_udf(DoubleType())
def key_value(k: pd.Series) -> pd.Series:
    """The double of a sort key."""
    bits = k.to_numpy(dtype=np.int64)
    return pd.Series(np.where(bits < 0, -1.0, 1.0) * np.abs(bits).view(np.float64))


def histogram(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Buckets of (keys, part) with their counts, spans, and the values counted before them."""
    cells = rows.groupBy(*keys, "__part", "__b").agg(
        F.count("__k").alias("__c"), F.min("__k").alias("__lo"), F.max("__k").alias("__hi")
    )
    before = Window.partitionBy(*keys, "__part").orderBy("__b")
    return cells.withColumn("__before", F.sum("__c").over(before) - F.col("__c"))


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], bits: int = BUCKET_BITS
) -> DataFrame:
    """Quantiles interpolated at (n-1)p, exact, by radix histograms refined where ranks fall.

    The values are stored once beside their group. A pass counts them in at most 2**``bits``
    buckets per group and part; a bucket that holds a wanted rank becomes a part of the next
    pass, cut between the smallest and largest value found in it, and all others are left out.
    Counts say for certain which bucket holds a rank, so there is no bracket to miss. A part
    of up to 2**``bits`` values is cut down to single values; what a rank keeps does not grow
    with its group. Groups of NULLs alone have NULL quantiles, NaN is the largest value.
    """
    keys, names = list(keys), list(probs)
    x = F.col(value).cast("double")
    rows = written(df.select(*keys, F.when(x.isNotNull(), sort_key(x)).alias("__k")), "quantile-values")
    rows = rows.withColumns({"__part": F.lit(0).cast("long"), "__b": F.shiftright("__k", 64 - bits)})

    def holders(cells: DataFrame, ranks: Column) -> tuple[DataFrame, dict]:
        """The buckets that hold a wanted rank, with the rank's number in the bucket."""
        inside = F.filter(ranks, lambda r: (r["rank"] >= F.col("__before")) & (r["rank"] < F.col("__before") + F.col("__c")))
        # Values that are NULL have a bucket of their own, which keeps their group.
        none = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("w"), F.lit(0.0).alias("f"), F.lit(0).cast("long").alias("rank")))
        held = cells.select("*", F.explode(F.when(F.col("__b").isNull(), none).otherwise(inside)).alias("__r"))
        span = ["__part", "__b", "__c", "__lo", "__hi"]
        rank = (F.col("__r.rank") - F.col("__before")).alias("rank")
        held = held.select(*keys, *span, "__r.i", "__r.w", "__r.f", rank)
        return written_with(held, "quantile-ranks", open=F.count_if(F.col("__lo") < F.col("__hi")))

    wanted = []
    for i, p in enumerate(probs.values()):
        h = (F.col("__n") - 1) * F.lit(float(p))
        for w, rank in enumerate((F.floor(h), F.least(F.floor(h) + 1, F.col("__n") - 1))):
            wanted.append(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), (h - F.floor(h)).alias("f"), rank.alias("rank")))
    first = histogram(rows, keys).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
    targets, left = holders(first, F.array(*wanted))

    found = [targets.filter("__lo <=> __hi")]
    while left["open"]:
        open_ = targets.filter("__lo <> __hi")
        # Few values are told apart at once, others by the bits in which they may differ.
        wide = F.length(F.bin(F.col("__hi") - F.col("__lo")))
        shift = F.when(F.col("__c") <= 1 << bits, 0).otherwise(F.greatest(wide - bits, F.lit(0)))
        ranks = F.collect_list(F.struct("i", "w", "f", "rank")).alias("__ranks")
        parts = open_.groupBy(*keys, "__part", "__b", "__c", "__lo", "__hi").agg(ranks)
        parts = parts.select(*keys, "__part", "__b", F.col("__lo").alias("__next"), shift.alias("__shift"), "__ranks")
        rows = null_safe_join(rows, parts.drop("__ranks"), [*keys, "__part", "__b"])
        bucket = F.expr("shiftright(__k - __next, __shift)").alias("__b")
        rows = rows.select(*keys, "__k", F.col("__next").alias("__part"), bucket)
        ranks = parts.select(*keys, F.col("__next").alias("__part"), "__ranks")
        targets, left = holders(null_safe_join(histogram(rows, keys), ranks, [*keys, "__part"]), F.col("__ranks"))
        found.append(targets.filter("__lo = __hi"))

    # A bucket of one value: its key is the value. A NaN out of Python would be a NULL.
    lo = F.col("__lo")
    one = F.when(lo > TOP, F.lit(float("nan"))).when(lo.isNotNull(), key_value(F.coalesce(lo, F.lit(0).cast("long"))))
    every = reduce(DataFrame.union, found).withColumn("__x", one)
    at = lambda i, w, c="__x": F.max(F.when((F.col("i") == i) & (F.col("w") == w), F.col(c)))
    ends = [at(i, w).alias(f"__{w}_{i}") for i in range(len(names)) for w in (0, 1)]
    ends += [at(i, 0, "f").alias(f"__f_{i}") for i in range(len(names))]
    picked = every.groupBy(*keys).agg(*ends)
    low, high, part = ([F.col(f"__{c}_{i}") for i in range(len(names))] for c in ("0", "1", "f"))
    between = [F.when((a == b) | (f == 0), a).otherwise(a + f * (b - a)) for a, b, f in zip(low, high, part)]
    return picked.select(*keys, *[v.alias(name) for name, v in zip(names, between)])
