"""Medians with central intervals, and groups against the grand mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.sizing import null_safe_join
from tallymix.operators.quantiles import bounded_quantiles, group_quantiles


def median_interval(
    df: DataFrame, keys: Sequence[str], value: str, width: float = 0.95, bounded: bool = False
) -> DataFrame:
    """Median and central interval of a value per group.

    ``bounded`` says each group holds one value per draw, so a group fits in a task;
    otherwise groups may have any size.
    """
    tail = (1.0 - width) / 2.0
    probs = {"point": 0.5, "lower": tail, "upper": 1.0 - tail}
    quantiles = bounded_quantiles if bounded else group_quantiles
    return quantiles(df, keys, value, probs).select(
        *keys,
        "point",
        "lower",
        "upper",
        F.lit(float(width)).alias("width"),
        F.lit("median").alias("point_type"),
        F.lit("qi").alias("interval_type"),
    )


def averaged_probability(
    epred: DataFrame, group: str, draw: str, category: str, value: str = "epred"
) -> DataFrame:
    """Mean probability per (group, draw, category) over the rest of the grid."""
    return epred.groupBy(group, draw, category).agg(F.avg(value).alias(value))


def grand_mean(
    averaged: DataFrame, draw: str, category: str, value: str = "epred", name: str = "grand_mean_epred"
) -> DataFrame:
    """Unweighted mean over groups per (draw, category)."""
    return averaged.groupBy(draw, category).agg(F.avg(value).alias(name))


def group_vs_grand_mean(
    averaged: DataFrame,
    group: str,
    draw: str,
    category: str,
    value: str = "epred",
    width: float = 0.95,
    bounded: bool = True,
) -> DataFrame:
    """Each group's interval against the interval of the grand mean.

    Clear only if the intervals do not overlap.
    """
    names = ["point", "lower", "upper", "width", "point_type", "interval_type"]
    own = median_interval(averaged, [group, category], value, width, bounded)
    overall = median_interval(
        grand_mean(averaged, draw, category, value), [category], "grand_mean_epred", width, bounded
    )
    own = own.withColumnsRenamed({c: f"{c}_group" for c in names})
    overall = overall.withColumnsRenamed({c: f"{c}_grand_mean" for c in names})
    higher = F.col("lower_group") > F.col("upper_grand_mean")
    lower = F.col("upper_group") < F.col("lower_grand_mean")
    return (
        null_safe_join(own, overall, [category], "left")
        .withColumn("is_significant", higher | lower)
        .withColumn(
            "direction",
            F.when(higher, F.lit("Higher than average"))
            .when(lower, F.lit("Lower than average"))
            .otherwise(F.lit("Not significant")),
        )
    )
