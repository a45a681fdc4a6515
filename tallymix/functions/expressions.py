"""Column expressions with the NULL, rounding and level rules of the analyses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_distinct(column: str) -> Column:
    """Distinct values of a column, NULL counting as one value."""
    c = F.col(column)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def recode(column: Column, mapping: Mapping[str, str | None]) -> Column:
    """Replace listed values, pass every other value through."""
    pairs = [F.lit(x) for kv in mapping.items() if kv[1] is not None for x in kv]
    return F.coalesce(F.create_map(*pairs)[column], column)


def lookup(column: Column, mapping: Mapping[str, str | None]) -> Column:
    """The value listed for the column, NULL where none is."""
    pairs = [F.lit(x) for kv in mapping.items() if kv[1] is not None for x in kv]
    return F.create_map(*pairs)[column]


def in_levels(column: Column, levels: Sequence[str]) -> Column:
    """The column where it is one of the levels, NULL elsewhere.

    A lookup names the column once: nested recodings that name it twice grow past what is compiled.
    """
    return lookup(column, {v: v for v in levels})


def level_rank(column: Column, levels: Sequence[str]) -> Column:
    """1-based position in the ordered levels, NULL outside them."""
    return F.nullif(F.array_position(literals(levels), column).cast("int"), F.lit(0))


def move_last(levels: Sequence[str], level: str) -> list[str]:
    """The level order with one level moved to the end."""
    return [x for x in levels if x != level] + [level]


def to_number(column: Column, dtype: str = "double") -> Column:
    """Numeric value of a text column, NULL where it does not parse."""
    return column.try_cast(dtype)


def text_na_as_null(column: Column, token: str = "NA") -> Column:
    return F.nullif(column, F.lit(token))


def shorten(column: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) pairs in order."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, column)


def log_ratio(a: Column, b: Column) -> Column:
    return F.ln(a / b)


def no_negative_zero(column: Column) -> Column:
    return column + F.lit(0.0)


def is_listed(column: str, levels: Sequence[str]) -> Column:
    """Whether the column is one of the levels: false for NULL, raising for any other value."""
    c = F.col(column)
    text = F.concat(F.lit(f"{column} outside the given levels: "), c.cast("string"))
    other = F.raise_error(text).cast("boolean")
    return F.when(c.isNull(), F.lit(False)).when(c.isin(list(levels)), F.lit(True)).otherwise(other)


def only_levels(column: str, levels: Sequence[str]) -> Column:
    """The column, raising on a value outside the list. NULL is not outside."""
    c = F.col(column)
    text = F.concat(F.lit(f"{column} outside the given levels: "), c.cast("string"))
    return F.when(c.isNull() | c.isin(list(levels)), c).otherwise(F.raise_error(text))
