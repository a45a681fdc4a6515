"""What a multinomial model is made of: its terms and how they read off a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.functions.expressions import is_listed

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Design:
    """Category ~ numeric terms + factors (first level as reference)."""

    category: str
    levels: Sequence[str]  # first level is the base of all contrasts
    numeric: Sequence[str] = ()
    factors: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @property
    def covariates(self) -> list[str]:
        return [*self.numeric, *self.factors]

    @property
    def terms(self) -> list[str]:
        dummies = [f"{f}={v}" for f, vs in self.factors.items() for v in vs[1:]]
        return [INTERCEPT, *self.numeric, *dummies]

    def check(self, df: DataFrame) -> DataFrame:
        """Rows a model can use: no NULL in the category or a covariate.

        A category or factor level outside the lists raises, naming it.
        """
        for c in self.numeric:
            df = df.filter(F.col(c).isNotNull())
        for c, vs in {self.category: self.levels, **self.factors}.items():
            df = df.filter(is_listed(c, vs))
        return df

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        """Model matrix of a pandas frame, columns in the order of ``terms``."""
        cols = [np.ones(len(pdf))]
        cols += [pdf[c].to_numpy(dtype="float64") for c in self.numeric]
        cols += [
            (pdf[f] == v).to_numpy(dtype="float64") for f, vs in self.factors.items() for v in vs[1:]
        ]
        return np.column_stack(cols)

    def columns(self) -> list[Column]:
        """The same matrix as Spark columns, without the intercept."""
        cols = [F.col(c).cast("double") for c in self.numeric]
        cols += [
            F.when(F.col(f) == v, F.lit(1.0)).otherwise(F.lit(0.0))
            for f, vs in self.factors.items()
            for v in vs[1:]
        ]
        return cols

    def score(self, coef: Column, k: int) -> Column:
        """Linear predictor of category k from the flat coefficient array of a draw.

        A factor costs one array read at the row's level, not a product per dummy. Level
        positions are the ``__f_<factor>`` columns of ``with_positions``.
        """
        start = k * len(self.terms)
        out = coef[start]
        for j, c in enumerate(self.numeric):
            out = out + coef[start + 1 + j] * F.col(c)
        at = start + 1 + len(self.numeric)
        for f, vs in self.factors.items():
            pos = F.col(f"__f_{f}")
            if len(vs) > 1:
                out = out + F.when(pos == 0, F.lit(0.0)).otherwise(F.get(coef, pos + (at - 1)))
            at += len(vs) - 1
        return out

    def with_positions(self, df: DataFrame) -> DataFrame:
        """Add the 0-based level position of every factor; an unlisted or NULL level raises."""
        for f, vs in self.factors.items():
            text = F.concat(F.lit(f"{f} outside the given levels: "), F.coalesce(F.col(f).cast("string"), F.lit("NULL")))
            pos = F.array_position(F.array(*[F.lit(v) for v in vs]), F.col(f)).cast("int") - 1
            df = df.withColumn(f"__f_{f}", F.when(pos >= 0, pos).otherwise(F.raise_error(text).cast("int")))
        return df

    def drop_positions(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f"__f_{f}" for f in self.factors])


def to_cells(
    df: DataFrame, design: Design, by: Sequence[str] = (), n: str = "n"
) -> DataFrame:
    """Collapse rows to counts per (covariates, category): all the likelihood needs."""
    keys = [*by, *design.covariates, design.category]
    return design.check(df).groupBy(*keys).agg(F.count("*").alias(n))


def factor_levels(df: DataFrame, column: str) -> list[str]:
    """Levels of a factor in binary order, for a design.

    Only names that become model terms come to the driver: one per level, out of a
    distributed distinct.
    """
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().toLocalIterator()
    return sorted(r[0] for r in rows)
