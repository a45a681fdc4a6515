"""Running counts, running shares and running distinct counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymix.functions.expressions import literals, only_levels
from tallymix.functions.sizing import materialise, null_safe_join, written
from tallymix.operators.share import count_by


def complete_grid(
    counts: DataFrame,
    over: str,
    category: str,
    levels: Sequence[str],
    n: str = "n",
    fill=0,
) -> DataFrame:
    """A row for every (value of ``over`` present, level), absent ones filled.

    All levels are used, seen or not; a NULL category is a level too if it occurs. A value
    outside the levels raises: it would have no row where it is absent.
    The empty rows are appended and folded in by one aggregate: no join.
    """
    counts = counts.withColumn(category, only_levels(category, levels))
    # Every branch keeps ``n`` in its aggregate, so that all of them read the exchange of
    # the counts and the rows behind the counts are scanned once.
    null_seen = counts.agg(F.max(F.when(F.col(category).isNull(), F.coalesce(n, F.lit(0))))).scalar()
    wanted = F.when(null_seen.isNotNull(), literals([*levels, None])).otherwise(literals(levels))
    empty = (
        counts.groupBy(over)
        .agg(F.max(F.coalesce(n, F.lit(0))).alias("__seen"))
        .filter(F.col("__seen").isNotNull())
        .select(over, F.explode(wanted).alias(category), F.lit(None).cast("long").alias(n))
    )
    return (
        counts.select(over, category, n)
        .unionByName(empty)
        .groupBy(over, category)
        .agg(F.coalesce(F.max(n), F.lit(fill)).alias(n))
    )


def running_total(n: str, by: Sequence[str], order: str) -> Column:
    """Running sum of an aggregated count, NULL order values last."""
    w = (
        Window.partitionBy(*by)
        .orderBy(F.col(order).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.sum(n).over(w)


def cumulative_counts(
    df: DataFrame, category: str, order: str, levels: Sequence[str]
) -> DataFrame:
    """Running count per category over an ordered column, gaps filled with 0."""
    full = complete_grid(count_by(df, [order, category]), order, category, levels)
    return full.withColumn("cum_n", running_total("n", [category], order))


def cumulative_share(
    df: DataFrame, category: str, order: str, levels: Sequence[str]
) -> DataFrame:
    """Running category count over the running count of everything.

    Every category has a row at every step, so the running counts of one step add up to
    the running total: it is a window over that step, and nothing is joined back.
    """
    out = cumulative_counts(df, category, order, levels).withColumn(
        "total_cum_n", F.sum("cum_n").over(Window.partitionBy(order))
    )
    return out.filter(F.col("total_cum_n") > 0).withColumn(
        "cum_share", F.col("cum_n") / F.col("total_cum_n")
    )


def cumulative_distinct(
    df: DataFrame, category: str, order: str, values: Mapping[str, str]
) -> DataFrame:
    """Distinct values met so far per category, for each ``{output: column}``.

    A category has a row for every step present anywhere from its own first step on;
    NULL counts as one value; rows with a NULL category or step add nothing. A value
    counts at the first step it occurs: the minimum per (category, value). The rows are
    read once, into a stored table with one row per (category, step).
    """
    # The step itself is tracked as one more value, so a step that brings nothing new
    # still has a row.
    tracked = [("__step", order), *values.items()]
    firsts = (
        df.filter(F.col(order).isNotNull())
        .select(
            category,
            order,
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(out).alias("__kind"), F.col(c).cast("string").alias("__value"))
                        for out, c in tracked
                    ]
                )
            ),
        )
        .groupBy(category, "__kind", "__value")
        .agg(F.min(order).alias(order))
    )
    news = materialise(
        firsts.groupBy(category, order).agg(
            *[F.count_if(F.col("__kind") == out).alias(out) for out in values]
        )
    )
    known = news.filter(F.col(category).isNotNull())
    # The steps lie in ranges of their order. A category is dealt to the ranges from its own
    # first step on, and meets the steps of a range by a join on its number.
    steps = news.select(order).distinct().repartitionByRange(F.col(order))
    steps = written(steps.withColumn("__part", F.spark_partition_id()), "steps")
    last = steps.agg(F.max("__part")).first()[0] or 0
    known = known.join(steps, order)
    first = F.min(F.struct(order, "__part")).alias("__first")
    dealt = known.groupBy(category).agg(first)
    to_end = F.explode(F.sequence(F.col("__first.__part"), F.lit(last))).alias("__part")
    empty = dealt.select(category, F.col(f"__first.{order}").alias("__start"), to_end).join(steps, "__part")
    empty = empty.filter(F.col(order) >= F.col("__start"))
    empty = empty.select(category, "__part", order, *[F.lit(0).cast("long").alias(out) for out in values])
    full = known.select(*empty.columns).unionByName(empty)
    full = written(full.groupBy(category, "__part", order).agg(*[F.sum(o).alias(o) for o in values]), "step-counts")
    return prefix_sums(full, list(values), category, order, "__part")


def prefix_sums(df: DataFrame, columns: Sequence[str], by: str, order: str, part: str) -> DataFrame:
    """Running sums of columns per ``by``, in the order of the ranges ``part`` and within them.

    A window holds the steps of one range, another the ranges of one ``by``: neither holds
    all steps. NULLs of ``order`` come last.
    """
    earlier = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(by, part).agg(*[F.sum(c).alias(c) for c in columns])
    totals = totals.select(by, part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__before_{c}") for c in columns])
    within = df.withColumns({c: running_total(c, [by, part], order) for c in columns})
    both = null_safe_join(within, totals, [by, part])
    return both.select(by, order, *[(F.col(c) + F.col(f"__before_{c}")).alias(c) for c in columns])


def cumulative_max(curves: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The largest value each running count reaches."""
    return curves.agg(*[F.max(c).alias(f"max_{c}") for c in columns])
