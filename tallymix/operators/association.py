"""Two-way tables, residuals and the test of independence."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallymix.functions.expressions import only_levels
from tallymix.functions.sizing import written
from tallymix.operators.share import count_by


#: Most cells of a full grid, and columns of it in a block.
MAX_CELLS = 1_000_000_000
GRID_BLOCK = 10_000


def contingency(df: DataFrame, rows: str, cols: str, col_levels: Sequence[str]) -> DataFrame:
    """Two-way table of counts, zero cells kept, missing values dropped.

    A column value outside the levels raises.
    """
    df = df.withColumn(cols, only_levels(cols, col_levels))
    some = df.filter(F.col(rows).isNotNull() & F.col(cols).isNotNull())
    return some.groupBy(rows).agg(
        *[F.count_if(F.col(cols) == c).alias(c) for c in col_levels]
    )


def pearson_residuals(df: DataFrame, rows: str, cols: str, threshold: float = 2.0) -> DataFrame:
    """Observed against expected under independence, for the observed cells.

    All margins are windows or a scalar subquery over the cell counts; the rows behind
    them are read once.
    """
    cells = count_by(df, [rows, cols], "observed")
    row_total = F.sum("observed").over(Window.partitionBy(rows))
    col_total = F.sum("observed").over(Window.partitionBy(cols))
    out = cells.withColumn(
        "expected", row_total * (col_total / cells.agg(F.sum("observed")).scalar())
    )
    out = out.withColumn("residual", F.col("observed") - F.col("expected"))
    out = out.withColumn("pearson_residual", F.col("residual") / F.sqrt("expected"))
    return out.withColumn(
        "representation",
        F.when(F.col("pearson_residual") > threshold, F.lit("Over-represented"))
        .when(F.col("pearson_residual") < -threshold, F.lit("Under-represented"))
        .otherwise(F.lit("As Expected")),
    )


def residual_matrix(df: DataFrame, rows: str, cols: str, most: int = MAX_CELLS) -> DataFrame:
    """Pearson residuals over the full grid of rows and columns seen, zero cells included.

    More than ``most`` cells raise.
    """
    cells = count_by(df.filter(F.col(rows).isNotNull() & F.col(cols).isNotNull()), [rows, cols], "o")
    cells = written(cells, "cells")
    margins = cells.groupBy(rows).agg(F.sum("o").alias("__r"))
    col_margins = cells.groupBy(cols).agg(F.sum("o").alias("__c"))
    n, m, total = cells.agg(F.count_distinct(rows), F.count_distinct(cols), F.sum("o")).first()
    if n * m > most:
        raise ValueError(f"{n} values of {rows} and {m} of {cols} make more than {most} cells")
    # Rows are dealt to every block of columns: the full grid as an equi-join on the block.
    blocks = -(-m // GRID_BLOCK) or 1
    block = F.pmod(F.xxhash64(cols), F.lit(blocks)).cast("int").alias("__block")
    dealt = margins.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    grid = dealt.join(col_margins.select("*", block), "__block").drop("__block")
    total = F.lit(float(total or 0))
    observed = cells.select(rows, cols, "o")
    out = grid.join(observed, [rows, cols], "left").withColumn("observed", F.coalesce("o", F.lit(0)))
    expected = F.col("__r") * (F.col("__c") / total)
    return out.select(
        rows, cols, "observed", ((F.col("observed") - expected) / F.sqrt(expected)).alias("pearson_residual")
    )


@F.pandas_udf(DoubleType())
def chi2_upper_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-squared with df degrees > x), by the recurrence in steps of two degrees."""

    def tail(v, k):
        if pd.isna(v) or pd.isna(k) or k < 1:
            return None
        h = v / 2.0
        if h <= 0:
            return 1.0
        even = int(k) % 2 == 0
        q, a = (math.exp(-h), 1.0) if even else (math.erfc(math.sqrt(h)), 0.5)
        while a < k / 2.0:
            q += math.exp(a * math.log(h) - h - math.lgamma(a + 1.0))
            a += 1.0
        return min(q, 1.0)

    return pd.Series([tail(v, k) for v, k in zip(x, df)], dtype="float64")


def chi_squared(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Chi-squared test of independence: statistic, degrees of freedom, p-value.

    Over the full grid the statistic is N(sum(o^2/(r c)) - 1), in which a zero cell adds
    nothing, so the observed cells are enough. A 2x2 table gets the continuity
    correction; there every |o-e| is the same.
    """
    cells = count_by(df.filter(F.col(rows).isNotNull() & F.col(cols).isNotNull()), [rows, cols], "o")
    r = F.sum("o").over(Window.partitionBy(rows))
    c = F.sum("o").over(Window.partitionBy(cols))
    sums = (
        cells.withColumns({"r": r, "c": c})
        .withColumn("nr", F.count("*").over(Window.partitionBy(rows)))
        .withColumn("nc", F.count("*").over(Window.partitionBy(cols)))
        .agg(
            F.sum("o").alias("n"),
            F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("q"),
            F.count_distinct(rows).alias("n_rows"),
            F.count_distinct(cols).alias("n_cols"),
            F.sum(1 / (F.col("r") * F.col("nr").cast("double"))).alias("inv_r"),
            F.sum(1 / (F.col("c") * F.col("nc").cast("double"))).alias("inv_c"),
        )
    )
    plain = F.greatest(F.col("n") * (F.col("q") - 1), F.lit(0.0))
    # In a 2x2 table sum(1/e) = n sum(1/r) sum(1/c), and plain = d^2 sum(1/e).
    spread = F.col("n") * F.col("inv_r") * F.col("inv_c")
    d = F.sqrt(plain / spread)
    corrected = F.pow(d - F.least(F.lit(0.5), d), F.lit(2.0)) * spread
    two_by_two = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    out = sums.select(
        F.when(two_by_two, corrected).otherwise(plain).alias("statistic"),
        ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).cast("int").alias("df"),
    )
    return out.withColumn("p_value", chi2_upper_tail("statistic", "df"))
