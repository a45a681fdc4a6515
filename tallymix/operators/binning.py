"""Bins of years, of quantiles and of a geographic grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.functions.expressions import no_negative_zero
from tallymix.operators.quantiles import group_quantiles
from tallymix.operators.share import count_by


def step_start(x: Column, start: int, stop: int, step: int, close_last: bool = False) -> Column:
    """Start of the left-closed bin [a, a+step) holding x; NULL outside [start, stop).

    ``close_last`` lets the last bin include ``stop`` itself.
    """
    bin_ = (F.floor((x - start) / step) * step + start).cast("int")
    out = F.when((x >= start) & (x < stop), bin_)
    return out.when(x == stop, F.lit(stop - step)) if close_last else out


def bin_steps(
    df: DataFrame, column: str, start: int, stop: int, step: int, into: str,
    close_last: bool = False, suffix: str | None = None,
) -> DataFrame:
    """Label rows with their bin and drop those outside all bins."""
    label = step_start(F.col(column), start, stop, step, close_last)
    if suffix is not None:
        label = F.concat(label.cast("string"), F.lit(suffix))
    return df.withColumn(into, label).filter(F.col(into).isNotNull())


def quantile_breaks(df: DataFrame, column: str, n: int) -> DataFrame:
    """One row with the n+1 breaks of n equal-count bins; fails if breaks repeat."""
    probs = {f"__{i}": i / n for i in range(n + 1)}
    breaks = F.array(*[F.col(k) for k in probs])
    return group_quantiles(df, [], column, probs).select(
        F.when(F.size(F.array_distinct(breaks)) == n + 1, breaks)
        .otherwise(F.raise_error(F.lit(f"too few distinct values for {n} bins")).cast("array<double>"))
        .alias("breaks")
    )


def bin_quantile(df: DataFrame, column: str, n: int, into: str) -> DataFrame:
    """Number of the equal-count bin holding each value.

    Bins are right-closed, the first is closed on both sides, equal values always share
    a bin, and NULL has none.
    """
    breaks = quantile_breaks(df, column, n).scalar()
    out = df.withColumn("__b", breaks)
    above = sum(
        ((F.col(column) > F.col("__b")[i]).cast("int") for i in range(1, n)), F.lit(1)
    )
    return out.withColumn(into, F.when(F.col(column).isNotNull(), above)).drop("__b")


def bin_grid(df: DataFrame, columns: Sequence[tuple[str, str]], cell: float) -> DataFrame:
    """Centre of the grid cell of each coordinate; halves go to the even multiple."""
    return df.withColumns(
        {
            new: no_negative_zero(F.bround(F.col(old) / F.lit(float(cell))) * F.lit(float(cell)))
            for old, new in columns
        }
    )


def grid_counts(
    df: DataFrame,
    cells: Sequence[str],
    category: str,
    all_label: str = "All designs",
    n: str = "n_studies",
    distinct_id: str | None = None,
) -> DataFrame:
    """Counts per (cell, category) and per cell over all categories, stacked.

    The rows are collapsed to (cell, category) first; both grains come from one
    grouping-sets pass over those counts. With ``distinct_id`` entities are counted, and
    the collapse keeps (cell, category, entity).
    """
    keys = [*cells, category]
    if distinct_id:
        base = df.select(*keys, distinct_id).distinct()
        measure = F.count_distinct(distinct_id) + F.coalesce(
            F.max(F.col(distinct_id).isNull().cast("int")), F.lit(0)
        )
    else:
        base = count_by(df, keys, "__n")
        measure = F.sum("__n")
    sets = [[F.col(k) for k in keys], [F.col(k) for k in cells]]
    both = base.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        measure.alias(n), F.grouping(category).alias("__all")
    )
    return both.select(
        *cells,
        F.when(F.col("__all") == 1, F.lit(all_label)).otherwise(F.col(category)).alias(category),
        n,
    )
