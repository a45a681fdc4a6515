"""Cleaning and combining sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions import expressions as X
from tallymix.functions.ranking import with_position


def project(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Select columns, or {new: old} to rename or copy them on the way."""
    if isinstance(columns, Mapping):
        return df.select(*[F.col(old).alias(new) for new, old in columns.items()])
    return df.select(*columns)


def coerce_numeric(df: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Parse text columns: {new: (old, type)}; text that is no number becomes NULL."""
    return df.withColumns({n: X.to_number(F.col(o), t) for n, (o, t) in columns.items()})


def recode_category(
    df: DataFrame, column: str, mapping: Mapping[str, str], into: str | None = None
) -> DataFrame:
    """Replace listed values; others pass through unchanged."""
    return df.withColumn(into or column, X.recode(F.col(column), mapping))


def ordered_domain(
    df: DataFrame, column: str, levels: Sequence[str], rank: str | None = None
) -> DataFrame:
    """Restrict a column to closed, ordered levels; others become NULL."""
    out = df.withColumn(column, X.in_levels(F.col(column), levels))
    return out.withColumn(rank, X.level_rank(F.col(column), levels)) if rank else out


def levels_present(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """The levels that occur, with their rank among those that do."""
    present = df.filter(F.col(column).isin(list(levels))).groupBy(column).agg(F.count("*").alias("__n"))
    ranked = present.withColumn("__rank", X.level_rank(F.col(column), levels))
    found = ranked.agg(F.sort_array(F.collect_set("__rank"))).scalar()
    return ranked.select(column, F.array_position(found, F.col("__rank")).cast("int").alias("level_rank"))


def relevel(
    df: DataFrame, column: str, levels: Sequence[str], last: str, rank: str = "level_rank"
) -> DataFrame:
    """Rank by the levels with one of them moved to the end."""
    return df.withColumn(rank, X.level_rank(F.col(column), X.move_last(levels, last)))


def reversed_labels(df: DataFrame, column: str, into: str = "position") -> DataFrame:
    """Distinct labels in descending (binary) order with their position."""
    labels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return with_position(labels, [F.col(column).desc()], into)


def normalise_missing(df: DataFrame, columns: Sequence[str], token: str = "NA") -> DataFrame:
    """Text tokens that stand for a missing value become NULL."""
    return df.withColumns({c: X.text_na_as_null(F.col(c), token) for c in columns})


def append_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables by column name, whatever their column order."""
    for other in others:
        first = first.unionByName(other)
    return first


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a NULL in the given columns."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def filter_equal(df: DataFrame, column: str, value, negate: bool = False) -> DataFrame:
    """Rows equal (or unequal) to a value; a NULL satisfies neither."""
    return df.filter(F.col(column) != F.lit(value) if negate else F.col(column) == F.lit(value))


def value_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows in a closed range; pushed down to the scan."""
    return df.filter(F.col(column).between(low, high))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def shorten_labels(
    df: DataFrame, column: str, rules: Sequence[tuple[str, str]], into: str | None = None
) -> DataFrame:
    """Shorten display labels by an ordered chain of replacements.

    Meant for aggregated tables: two groups may end up with the same label.
    """
    return df.withColumn(into or column, X.shorten(F.col(column), rules))


def clean_source(
    df: DataFrame,
    names: Mapping[str, str],
    design_map: Mapping[str, str],
    levels: Sequence[str],
    constants: Mapping[str, str] | None = None,
) -> DataFrame:
    """One study source in the shape of the central table.

    ``names`` maps study_id, design, year, lat, long, continent, country (and synopsis,
    unless a constant gives it) to the source's own columns.
    """
    out = project(df, names).withColumns({k: F.lit(v) for k, v in (constants or {}).items()})
    out = coerce_numeric(
        out, {"year": ("year", "int"), "lat": ("lat", "double"), "long": ("long", "double")}
    )
    return ordered_domain(recode_category(out, "design", design_map), "design", levels)
