"""Wide and long forms, and the empirical logit built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.expressions import log_ratio, only_levels, to_number


def lengthen(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    names_to: str,
    values_to: str,
) -> DataFrame:
    """Wide to long; NULL cells keep their row."""
    return df.unpivot(list(ids), list(columns), names_to, values_to)


def lengthen_years(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], values_to: str, prefix: str = ""
) -> DataFrame:
    """Wide to long over year columns, the year taken from the column name."""
    long = lengthen(df, ids, columns, "year", values_to)
    text = F.regexp_replace("year", prefix, "") if prefix else F.col("year")
    return long.withColumn("year", to_number(text, "int"))


def widen(
    counts: DataFrame, key: str, category: str, levels: Sequence[str], n: str = "n", fill=None
) -> DataFrame:
    """Long to wide, one column per level; absent cells take the fill value.

    A value outside the levels raises rather than vanish.
    """
    counts = counts.withColumn(category, only_levels(category, levels))
    wide = counts.groupBy(key).pivot(category, list(levels)).agg(F.first(n))
    if fill is None:
        return wide
    return wide.withColumns({x: F.coalesce(F.col(f"`{x}`"), F.lit(fill)) for x in levels})


def empirical_logit(
    counts: DataFrame,
    key: str,
    category: str,
    levels: Sequence[str],
    base: str,
    n: str = "n",
    names_to: str = "comparison",
    values_to: str = "logit_value",
) -> DataFrame:
    """Log of each category count over the base count, per bin.

    An absent (bin, category) cell counts as 1; present cells are left as they are.
    """
    others = [x for x in levels if x != base]
    wide = widen(counts, key, category, levels, n, fill=1)
    ratios = wide.select(
        key, *[log_ratio(F.col(f"`{x}`"), F.col(f"`{base}`")).alias(f"{x} vs. {base}") for x in others]
    )
    return ratios.select(
        key,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{x} vs. {base}").alias(names_to),
                        F.col(f"`{x} vs. {base}`").alias(values_to),
                    )
                    for x in others
                ]
            )
        ),
    )
