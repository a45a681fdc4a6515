"""Three-knot restricted cubic spline as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.operators.quantiles import group_quantiles

# Usual quantiles of the knots of a three-knot spline.
KNOT_PROBS = {"k1": 0.1, "k2": 0.5, "k3": 0.9}


def knots(df: DataFrame, x: str) -> DataFrame:
    """One row with the three knots of a column."""
    return group_quantiles(df, [], x, KNOT_PROBS)


def spline_column(x: Column, k: Sequence[Column]) -> Column:
    """The one non-linear column of the basis; linear beyond the outer knots."""

    def cube(c):
        return F.pow(F.greatest(c, F.lit(0.0)), F.lit(3.0))

    k1, k2, k3 = k
    bend = (
        cube(x - k1)
        - cube(x - k2) * ((k3 - k1) / (k3 - k2))
        + cube(x - k3) * ((k2 - k1) / (k3 - k2))
    )
    return bend / F.pow(k3 - k1, F.lit(2.0))


def spline_features(df: DataFrame, x: str, into: str, at: Sequence[float] | None = None) -> DataFrame:
    """Add the spline column of x, with given knots or those of the data."""
    if at is not None:
        return df.withColumn(into, spline_column(F.col(x), [F.lit(float(v)) for v in at]))
    k = knots(df, x).select(F.struct("k1", "k2", "k3")).scalar()
    return (
        df.withColumn("__k", k)
        .withColumn(
            into, spline_column(F.col(x), [F.col("__k.k1"), F.col("__k.k2"), F.col("__k.k3")])
        )
        .drop("__k")
    )
