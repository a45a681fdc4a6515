"""Probabilities, curves, slopes and checks from the draws of a fit."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallymix.functions.sizing import written
from tallymix.models.design import Design
from tallymix.operators.intervals import median_interval

MAX_BROADCAST_BYTES = 128 * 1024 * 1024
#: Most rows of a covariate grid, and values of its second covariate in a block.
MAX_GRID = 1_000_000_000
GRID_BLOCK = 10_000


def pack_draws(draws: DataFrame, design: Design) -> DataFrame:
    """One row per draw with its coefficients as a flat array, category by category."""
    place = {}
    for k, c in enumerate(design.levels):
        for j, t in enumerate(design.terms):
            place[f"{c}|{t}"] = k * len(design.terms) + j
    at = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    pairs = F.struct(at[F.concat("category", F.lit("|"), "term")].alias("at"), "estimate")
    return (
        draws.filter(F.col("category") != design.levels[0])
        .groupBy("draw")
        .agg(F.sort_array(F.collect_list(pairs)).alias("__p"))
        .select(
            "draw",
            F.concat(
                F.array_repeat(F.lit(0.0), len(design.terms)), F.col("__p.estimate")
            ).alias("__coef"),
        )
    )


def with_probabilities(rows: DataFrame, design: Design) -> DataFrame:
    """Rows that carry ``__coef`` with the probability of each category as ``__p0``, ``__p1``, .."""
    k = len(design.levels)
    rows = design.with_positions(rows)
    rows = rows.withColumns({f"__e{i}": design.score(F.col("__coef"), i) for i in range(k)})
    top = F.greatest(*[F.col(f"__e{i}") for i in range(k)]) if k > 1 else F.col("__e0")
    rows = rows.withColumns({f"__x{i}": F.exp(F.col(f"__e{i}") - top) for i in range(k)})
    norm = sum((F.col(f"__x{i}") for i in range(1, k)), F.col("__x0"))
    rows = rows.withColumn("__norm", norm)
    rows = rows.withColumns({f"__p{i}": F.col(f"__x{i}") / F.col("__norm") for i in range(k)})
    rows = rows.drop("__norm", *[f"__{a}{i}" for a in "ex" for i in range(k)])
    return design.drop_positions(rows)


def over_draws(grid: DataFrame, draws: DataFrame, design: Design, n_draws: int) -> DataFrame:
    """Each grid row once per draw, with its category probabilities.

    The packed draws are n_draws rows of categories x terms doubles. They are broadcast
    if that product is small, otherwise joined on the draw by shuffle.
    """
    packed = pack_draws(draws, design)
    if n_draws * len(design.levels) * len(design.terms) * 8 <= MAX_BROADCAST_BYTES:
        packed = F.broadcast(packed)
    rows = grid.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    return with_probabilities(rows.join(packed, "draw"), design)


def fitted_moments(
    cells: DataFrame, draws: DataFrame, design: Design, prior_sd: float | None, centre: Mapping[str, float], n: str = "n"
) -> DataFrame:
    """(draw, category, term, moment): what the fits say the sums of the data must be.

    The optimum of the penalised likelihood is where the expected sum of a term over the
    rows of a category, plus the pull of the prior on its symmetric slope, is the observed
    sum. Numeric terms are taken about ``centre``.
    """
    p, k = len(design.terms), len(design.levels)
    weights = cells.groupBy("draw", *design.covariates).agg(F.sum(n).alias("__n"))
    packed = pack_draws(draws, design)
    rows = with_probabilities(weights.join(packed, "draw"), design)
    x = [F.lit(1.0), *(F.col(c).cast("double") - F.lit(float(centre.get(c, 0.0))) for c in design.numeric)]
    x += [(F.col(f) == v).cast("double") for f, vs in design.factors.items() for v in vs[1:]]
    sums = [F.sum(F.col("__n") * F.col(f"__p{i}") * v).alias(f"__m{i}_{j}") for i in range(k) for j, v in enumerate(x)]
    pull = 0.0 if prior_sd is None else 1.0 / prior_sd**2
    coef = F.col("__coef")

    def moment(i: int, j: int):
        if not j:
            return F.col(f"__m{i}_0")
        mean = sum((coef[a * p + j] for a in range(1, k)), coef[j]) / F.lit(float(k))
        return F.col(f"__m{i}_{j}") + F.lit(pull) * (coef[i * p + j] - mean)

    each = [
        F.struct(F.lit(c).alias("category"), F.lit(t).alias("term"), moment(i, j).alias("moment"))
        for i, c in enumerate(design.levels)
        for j, t in enumerate(design.terms)
    ]
    return rows.groupBy("draw").agg(*sums).join(packed, "draw").select("draw", F.inline(F.array(*each)))


def by_category(design: Design, values: Sequence[Column], name: str) -> Column:
    """Array of (category, value), one entry per category, to be inlined."""
    return F.array(
        *[
            F.struct(F.lit(c).alias(design.category), v.alias(name))
            for c, v in zip(design.levels, values)
        ]
    )


def probabilities(design: Design) -> list[Column]:
    return [F.col(f"__p{i}") for i in range(len(design.levels))]


def covariate_grid(df: DataFrame, first: str, second: str, most: int = MAX_GRID) -> DataFrame:
    """Every distinct value of one covariate with every distinct value of another.

    NULL is a value if it occurs. The distinct values of both are stored and counted; a grid
    of more than ``most`` rows raises. Each value of the first is dealt to every block of the
    second, and the product is an equi-join on the block.
    """
    one = written(df.select(F.col(first).alias("__a")).distinct(), "grid-values")
    two = written(df.select(F.col(second).alias("__b")).distinct(), "grid-values")
    n, m = one.count(), two.count()
    if n * m > most:
        raise ValueError(f"a grid of {n} values of {first} and {m} of {second} has more than {most} rows")
    blocks = -(-m // GRID_BLOCK) or 1
    block = F.pmod(F.xxhash64("__b"), F.lit(blocks)).cast("int").alias("__block")
    dealt = one.select("__a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    return dealt.join(two.select("__b", block), "__block").select(F.col("__a").alias(first), F.col("__b").alias(second))


def epred_draws(grid: DataFrame, draws: DataFrame, design: Design, n_draws: int) -> DataFrame:
    """Probability per grid row, draw and category, without random effects."""
    return over_draws(grid, draws, design, n_draws).select(
        *grid.columns, "draw", F.inline(by_category(design, probabilities(design), "epred"))
    )


def conditional_curve(
    cells: DataFrame,
    draws: DataFrame,
    design: Design,
    x: str,
    n_draws: int,
    points: int = 100,
    width: float = 0.95,
    n: str = "n",
) -> DataFrame:
    """Probabilities along x with intervals; other covariates at mean or reference level."""
    others = [c for c in design.numeric if c != x]
    grid = cells.agg(
        F.min(x).cast("double").alias("__lo"),
        F.max(x).cast("double").alias("__hi"),
        *[(F.sum(F.col(c) * F.col(n)) / F.sum(n)).alias(c) for c in others],
    ).select(
        *others,
        *[F.lit(vs[0]).alias(f) for f, vs in design.factors.items()],
        "__lo",
        "__hi",
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"),
    )
    at = F.col("__lo") + F.col("step") * (F.col("__hi") - F.col("__lo")) / F.lit(float(points - 1))
    grid = grid.withColumn(x, at).drop("__lo", "__hi")
    return median_interval(
        epred_draws(grid, draws, design, n_draws),
        ["step", x, design.category],
        "epred",
        width,
        bounded=True,
    )


def average_slope(
    cells: DataFrame,
    draws: DataFrame,
    design: Design,
    x: str,
    n_draws: int,
    width: float = 0.95,
    n: str = "n",
) -> DataFrame:
    """Change of each probability per unit of x, averaged over the observed rows.

    p_k (b_k - sum_j p_j b_j) per covariate cell and draw, weighted by the rows of a
    cell, then median and interval over draws.
    """
    weights = cells.groupBy(*design.covariates).agg(F.sum(n).alias("__n"))
    scored = over_draws(weights, draws, design, n_draws)
    j = design.terms.index(x)
    size, k = len(design.terms), len(design.levels)
    b = [F.col("__coef")[i * size + j] for i in range(k)]
    p = probabilities(design)
    scored = scored.withColumn("__mean", sum((p[i] * b[i] for i in range(1, k)), p[0] * b[0]))
    slopes = [p[i] * (b[i] - F.col("__mean")) for i in range(k)]
    per_draw = (
        scored.groupBy("draw")
        .agg(*[(F.sum(F.col("__n") * s) / F.sum("__n")).alias(f"__s{i}") for i, s in enumerate(slopes)])
        .select("draw", F.inline(by_category(design, [F.col(f"__s{i}") for i in range(k)], "slope")))
    )
    return median_interval(per_draw, [design.category], "slope", width, bounded=True)


def coefficient_summary(draws: DataFrame, width: float = 0.95) -> DataFrame:
    """Mean, standard deviation and interval of each coefficient over draws."""
    tail = (1.0 - width) / 2.0
    q = F.percentile("estimate", F.array(F.lit(tail), F.lit(1.0 - tail)))
    return (
        draws.groupBy("category", "term")
        .agg(
            F.avg("estimate").alias("estimate"),
            F.stddev_samp("estimate").alias("std_error"),
            q.alias("__q"),
        )
        .select(
            "category",
            "term",
            "estimate",
            "std_error",
            F.col("__q")[0].alias("conf_low"),
            F.col("__q")[1].alias("conf_high"),
        )
    )


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of its parts: 32 bits, the same in any engine."""
    key = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]))
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


@F.pandas_udf(LongType())
def binomial_quantile(n: pd.Series, p: pd.Series, u: pd.Series) -> pd.Series:
    """The smallest k whose binomial(n, p) distribution function reaches u.

    The sum of probabilities runs outward from the mode, so its length is a few standard
    deviations whatever n is, and nothing underflows.
    """

    def one(n: int, p: float, u: float) -> int:
        if n <= 0 or p <= 0:
            return 0
        if p >= 1:
            return n
        mode = min(int((n + 1) * p), n)
        reach = int(9 * math.sqrt(n * p * (1 - p))) + 30
        low, high = max(mode - reach, 0), min(mode + reach, n)
        k = np.arange(low, high + 1, dtype=float)
        # Ratios of neighbouring probabilities, summed as logarithms from the mode.
        step = np.log((n - k[:-1]) / (k[:-1] + 1)) + math.log(p / (1 - p))
        log = np.concatenate([[0.0], np.cumsum(step)])
        weight = np.exp(log - log.max())
        upto = np.cumsum(weight)
        return low + int(np.searchsorted(upto, u * upto[-1]))

    return pd.Series([one(int(a), float(b), float(c)) for a, b, c in zip(n, p, u)], dtype="int64")


def replicated(scored: DataFrame, design: Design, by: Sequence[str], n: str, seed: str) -> DataFrame:
    """New counts per category of each (draw, cell): a multinomial draw of the cell's rows.

    The categories take their rows one after another, each a binomial of what is left. The
    uniform numbers are hashes of the seed, draw, cell and category, so a rerun draws the same.
    """
    left, rest, p = F.col(n).cast("long"), F.lit(1.0), probabilities(design)
    out, k = scored, len(design.levels)
    for i in range(k - 1):
        share = F.least(F.greatest(F.try_divide(p[i], rest), F.lit(0.0)), F.lit(1.0))
        u = uniform(F.lit(seed), F.col("draw"), *[F.col(c) for c in by], F.lit(i))
        out = out.withColumn(f"__y{i}", binomial_quantile(left, F.coalesce(share, F.lit(0.0)), u))
        left, rest = left - F.col(f"__y{i}"), rest - p[i]
    return out.withColumn(f"__y{k - 1}", left)


def predictive_check(
    cells: DataFrame,
    draws: DataFrame,
    design: Design,
    n_draws: int,
    by: Sequence[str] = (),
    width: float = 0.95,
    n: str = "n",
    seed: str | None = None,
) -> DataFrame:
    """Observed counts per category (and group) against those the model gives over draws.

    Without a seed these are expected counts, whose bands hold the uncertainty of the fit
    alone. With one, each cell's rows are drawn anew from its probabilities in every draw
    (``replicated``), so that the bands hold the noise of sampling as well.
    """
    cat = design.category
    weights = cells.groupBy(*design.covariates).agg(F.sum(n).alias("__n"))
    k = len(design.levels)
    scored = over_draws(weights, draws, design, n_draws)
    if seed is None:
        counts = [F.col("__n") * p for p in probabilities(design)]
    else:
        scored = replicated(scored, design, design.covariates, "__n", seed)
        counts = [F.col(f"__y{i}").cast("double") for i in range(k)]
    expected = (
        scored.groupBy("draw", *by)
        .agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(counts)])
        .select(
            "draw", *by, F.inline(by_category(design, [F.col(f"__s{i}") for i in range(k)], "expected"))
        )
    )
    observed = cells.groupBy(*by, cat).agg(F.sum(n).alias("observed"))
    bands = median_interval(expected, [*by, cat], "expected", width, bounded=True)
    return bands.join(observed, [*by, cat], "left").withColumn(
        "observed", F.coalesce("observed", F.lit(0))
    )


def variance_inflation(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """1 / (1 - R^2) of each predictor on the others, from one pass of correlations."""
    p = list(predictors)
    rows = df
    for c in p:
        rows = rows.filter(F.col(c).isNotNull())
    pairs = [(i, j) for i in range(len(p)) for j in range(i)]
    got = rows.agg(*[F.corr(p[i], p[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    r = np.eye(len(p))
    for i, j in pairs:
        r[i, j] = r[j, i] = got[f"r{i}_{j}"]
    inverse = np.linalg.inv(r)
    return df.sparkSession.createDataFrame(
        [(c, float(inverse[i, i])) for i, c in enumerate(p)], "term string, vif double"
    )
