"""Coverage, consistency and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.expressions import n_distinct
from tallymix.functions.sizing import null_safe_join
from tallymix.operators.quantiles import group_quantiles


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: distinct values per column, NULL counted as one."""
    return df.agg(*[n_distinct(c).alias(f"n_{c}") for c in columns])


def diversity(df: DataFrame, by: str, category: str, name: str = "n_categories") -> DataFrame:
    """Distinct categories per group."""
    return df.groupBy(by).agg(n_distinct(category).alias(name))


def multi_category_ids(
    df: DataFrame, entity: str, category: str, at_least: int = 2, name: str = "n_categories"
) -> DataFrame:
    """Entities seen with at least so many distinct categories."""
    return diversity(df, entity, category, name).filter(F.col(name) >= at_least)


def consistent_multi_group(df: DataFrame, entity: str, group: str, category: str) -> DataFrame:
    """Entities in two or more groups that keep a single category throughout.

    Both conditions come from one aggregate per entity, so the facts are read once and
    shuffled only as distinct (entity, group, category) rows.
    """
    seen = df.select(entity, group, category).distinct()
    return (
        seen.groupBy(entity)
        .agg(n_distinct(group).alias("n_groups"), n_distinct(category).alias("n_categories"))
        .filter((F.col("n_groups") >= 2) & (F.col("n_categories") == 1))
    )


def keep_listed(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in a computed set.

    The set is left lazy: its aggregate is already dealt by the key, and adaptive execution
    broadcasts it if it turns out small.
    """
    return null_safe_join(df, keys.select(*on).distinct(), on, "left_semi")


def drop_listed(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in a computed set; a NULL key is matched like any other."""
    return null_safe_join(df, keys.select(*on).distinct(), on, "left_anti")


def coverage_filter(df: DataFrame, group: str, category: str, at_least: int) -> DataFrame:
    """Drop every group that has fewer than ``at_least`` distinct categories."""
    thin = diversity(df, group, category, "__n").filter(F.col("__n") < at_least)
    return drop_listed(df, thin, [group])


def lowest_coverage(df: DataFrame, by: str, category: str, n: int) -> DataFrame:
    """The n groups with the fewest distinct categories (ties in key order)."""
    return (
        diversity(df, by, category)
        .orderBy(F.col("n_categories").asc(), F.col(by).asc_nulls_last())
        .limit(n)
    )


def unmatched(facts: DataFrame, dim: DataFrame, on: Sequence[str], show: Sequence[str]) -> DataFrame:
    """Distinct fact keys that have no row in the dimension.

    The facts are collapsed to distinct keys before they meet the dimension.
    """
    seen = facts.select(*dict.fromkeys([*on, *show])).distinct()
    return null_safe_join(seen, dim.select(*on).distinct(), on, "left_anti").select(*show).distinct()


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the left table absent from the right; NULL equals NULL."""
    return left.select(key).distinct().subtract(right.select(key).distinct())


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each named table."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: rows, NULLs, min, quartiles, mean, max."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    base = long.groupBy("column_name").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
    )
    quartiles = group_quantiles(
        long, ["column_name"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    return base.join(quartiles, "column_name", "left")
