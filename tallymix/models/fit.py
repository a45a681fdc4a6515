"""Penalised multinomial fits: Newton steps of many groups at once, summed by Spark."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.sizing import written, written_with
from tallymix.models.design import Design

PRIOR_SD = 2.5
COEFFICIENT_SCHEMA = "category string, term string, estimate double"


def contrasts(beta: np.ndarray) -> np.ndarray:
    """Coefficients per category less those of the base (first) category."""
    return beta - beta[:1]


def folded(cells: DataFrame, by: str, design: Design, n: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """One row per (``by``, covariates) with the weight of each category, stored.

    Numeric covariates are centred and scaled for the optimiser, by the same numbers in
    every group; these are returned per term.
    """
    of = [F.coalesce(F.sum(F.when(F.col(design.category) == v, F.col(n).cast("double"))), F.lit(0.0)) for v in design.levels]
    rows = cells.groupBy(by, *design.covariates).agg(*[y.alias(f"__y{k}") for k, y in enumerate(of)])
    spark = cells.sparkSession
    # An explicit number of tasks: by their bytes alone all rows would be put into one.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, F.xxhash64(by, *design.covariates))
    rows = written(design.with_positions(rows), "fit-cells")
    weight = sum((F.col(f"__y{k}") for k in range(len(design.levels))), F.lit(0.0))
    centre, scale = np.zeros(len(design.terms)), np.ones(len(design.terms))
    if design.numeric:
        x = [F.col(c).cast("double") for c in design.numeric]
        first = rows.agg(F.sum(weight), *[F.sum(weight * v) for v in x]).first()
        if first[0]:
            centre[1 : len(x) + 1] = [v / first[0] for v in first[1:]]
            spread = [F.sum(weight * (v - F.lit(float(m))) ** 2) for v, m in zip(x, centre[1:])]
            scale[1 : len(x) + 1] = [np.sqrt(v / first[0]) or 1.0 for v in rows.agg(*spread).first()]
        for i, (c, v) in enumerate(zip(design.numeric, x), start=1):
            rows = rows.withColumn(c, (v - F.lit(float(centre[i]))) / F.lit(float(scale[i])))
    return rows, centre, scale


def derivatives(rows: DataFrame, by: str, design: Design) -> DataFrame:
    """Log-likelihood, gradient and Hessian of each group at its coefficients ``trial``.

    One row per (``by``, i, j) of terms i <= j that occur together. ``h`` holds the
    upper triangle over category pairs. Row (0, j) has the gradient of term j in ``g``
    and (0, 0) the log-likelihood in ``ll``. A cell takes part only in the terms it has.
    """
    k = len(design.levels)
    terms = [F.struct(F.lit(0).alias("t"), F.lit(1.0).alias("z"))]
    terms += [F.struct(F.lit(i).alias("t"), F.col(c).alias("z")) for i, c in enumerate(design.numeric, start=1)]
    at = 1 + len(design.numeric)
    for f, vs in design.factors.items():
        position = F.col(f"__f_{f}")
        index = F.when(position > 0, position + (at - 1)).cast("int")
        terms.append(F.struct(index.alias("t"), F.lit(1.0).alias("z")))
        at += len(vs) - 1
    ys = [f"__y{a}" for a in range(k)]
    rows = rows.select(
        by,
        F.filter(F.array(*terms), lambda s: s["t"].isNotNull()).alias("__terms"),
        *ys,
        *[design.score(F.col("trial"), a).alias(f"__s{a}") for a in range(k)],
    )
    scores = [F.col(f"__s{a}") for a in range(k)]
    rows = rows.withColumn("__top", F.greatest(*scores) if k > 1 else scores[0])
    rows = rows.withColumn("__norm", sum((F.exp(s - F.col("__top")) for s in scores), F.lit(0.0)))
    rows = rows.withColumn("__w", sum((F.col(y) for y in ys), F.lit(0.0)))
    ll = sum((F.col(y) * (s - F.col("__top") - F.log("__norm")) for y, s in zip(ys, scores)), F.lit(0.0))
    rows = rows.select(
        by, "__terms", "__w", *ys, ll.alias("__ll"),
        *[(F.exp(s - F.col("__top")) / F.col("__norm")).alias(f"__p{a}") for a, s in enumerate(scores)],
    )
    pairs = rows.withColumn("__u", F.explode("__terms")).withColumn("__v", F.explode("__terms"))
    pairs = pairs.filter("__u.t <= __v.t").withColumn("__zz", F.col("__u.z") * F.col("__v.z"))
    prob = [F.col(f"__p{a}") for a in range(k)]
    h = [
        F.sum(F.col("__zz") * F.col("__w") * prob[a] * (F.lit(float(a == b)) - prob[b]))
        for a in range(k)
        for b in range(a, k)
    ]
    g = [F.sum(F.col("__zz") * (F.col(y) - F.col("__w") * p)) for y, p in zip(ys, prob)]
    return pairs.groupBy(by, F.col("__u.t").alias("i"), F.col("__v.t").alias("j")).agg(
        F.array(*h).alias("h"), F.array(*g).alias("g"), F.sum("__ll").alias("ll"), F.sum("__w").alias("w")
    )


def advanced(sums: pd.DataFrame, last: pd.Series, k: int, p: int, ridge: np.ndarray) -> tuple:
    """The next (trial, base, step, rate, value, state) of a group from its derivatives.

    A trial that lowers the objective halves the step from ``base``; any other becomes
    the base of a new Newton step. The group is done when the Newton decrement and the
    gradient vanish.
    """
    trial, base, step = (np.asarray(last[c], dtype=float).reshape(k, p) for c in ("trial", "base", "step"))
    origin = sums[(sums["i"] == 0) & (sums["j"] == 0)].iloc[0]
    value = float(origin["ll"]) - 0.5 * float((trial * trial * ridge).sum())
    if not value >= last["value"] - 1e-12 * abs(last["value"]):
        rate = last["rate"] / 2
        state = "open" if rate > 1e-9 else "stuck"
        return base + rate * step, base, step, rate, last["value"], state
    grad, hess = -trial * ridge, np.zeros((k, p, k, p))
    upper = np.triu_indices(k)
    for i, j, h, g in zip(sums["i"], sums["j"], sums["h"], sums["g"]):
        block = np.zeros((k, k))
        block[upper] = h
        block = np.triu(block) + np.triu(block, 1).T
        hess[:, i, :, j] = hess[:, j, :, i] = block
        if i == 0:
            grad[:, j] += g
    for a in range(k):
        hess[a, np.arange(p), a, np.arange(p)] += ridge
    step = np.linalg.lstsq(hess.reshape(k * p, k * p), grad.ravel(), rcond=1e-13)[0].reshape(k, p)
    flat = (grad * step).sum() <= 1e-12 and np.abs(grad).max() <= 1e-8 * max(1.0, float(origin["w"]))
    return trial + step, trial, step, 1.0, value, "done" if flat else "open"


def multinomial_fit(
    cells: DataFrame, design: Design, n: str = "n", prior_sd: float | None = PRIOR_SD
) -> DataFrame:
    """Penalised-likelihood coefficients as contrasts to the base category.

    Slopes carry a ridge equivalent to normal(0, prior_sd) on the symmetric softmax
    scale; intercepts are free. These are population-averaged coefficients, not those of
    a study with zero random effect.
    """
    return fit_groups(cells.withColumn("__all", F.lit(1)), "__all", 1, design, n, prior_sd).drop("__all")


def fit_groups(
    cells: DataFrame,
    by: str,
    groups: int,
    design: Design,
    n: str = "n",
    prior_sd: float | None = PRIOR_SD,
    steps: int = 100,
) -> DataFrame:
    """One fit per value 1..groups of ``by`` (a draw or a fold), by one method at any size.

    Newton steps: an iteration is one job, in which Spark sums the derivatives of all
    groups over their cells; a task then solves for the step of a group, whose size is
    that of its coefficients. The state between steps is a written table of a row per
    group, so that no step inherits the plan of the one before it. Groups leave when they
    have converged. If one has not after ``steps`` iterations this raises, naming it.
    Where a category does not occur beside a free coefficient, that coefficient has no
    finite optimum and stays where its gradient vanishes.
    """
    spark, k, terms = cells.sparkSession, len(design.levels), design.terms
    p = len(terms)
    rows, centre, scale = folded(cells.filter(F.col(by).between(1, groups)), by, design, n)
    ridge = np.zeros(p) if prior_sd is None else np.r_[0.0, 1.0 / (prior_sd * scale[1:]) ** 2]
    tasks = min(groups, max(1, spark.sparkContext.defaultParallelism))
    fields = "trial array<double>, base array<double>, step array<double>, rate double, value double, state string"
    schema = f"{by} int, {fields}"

    def advance(sums: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
        trial, base, step, *rest = advanced(sums, last.iloc[0], k, p, ridge)
        now = [int(last[by].iloc[0]), *(x.ravel().tolist() for x in (trial, base, step)), *rest]
        return pd.DataFrame([now], columns=last.columns)

    # Intercepts start at the log shares of the categories, slopes at zero.
    logs = [F.log(F.sum(f"__y{a}") + 0.5) for a in range(k)]
    mean = sum(logs[1:], logs[0]) / F.lit(float(k))
    zeros = F.array_repeat(F.lit(0.0), k * p)
    slopes = F.array_repeat(F.lit(0.0), p - 1)
    start = F.concat(*[x for log in logs for x in (F.array(log - mean), slopes)])
    state = rows.groupBy(F.col(by).cast("int").alias(by)).agg(start.alias("trial")).select(
        by, "trial", zeros.alias("base"), zeros.alias("step"),
        F.lit(1.0).alias("rate"), F.lit(float("-inf")).alias("value"), F.lit("open").alias("state"),
    )
    count = {k: F.count_if(F.col("state") == k) for k in ("open", "done", "stuck")}
    done: list[DataFrame] = []
    state, left = written_with(state, "fit-state", **count)
    for _ in range(steps):
        if not left["open"] or left["stuck"]:
            break
        sums = derivatives(rows.join(state.select(by, "trial"), by), by, design)
        sums, last = sums.repartition(tasks, by), state.repartition(tasks, by)
        new = sums.groupBy(by).cogroup(last.groupBy(by)).applyInPandas(advance, schema)
        new, left = written_with(new, "fit-state", **count)
        if left["done"]:
            done.append(new.filter("state = 'done'"))
        state = new.filter("state <> 'done'")
    if left["open"] or left["stuck"]:
        bad = [r[0] for r in state.select(by).orderBy(by).limit(5).collect()]
        raise ValueError(f"no convergence for {by} {bad}")
    if not done:
        return spark.createDataFrame([], f"{by} int, {COEFFICIENT_SCHEMA}")

    def estimates(batches):
        for pdf in batches:
            for g, trial in zip(pdf[by], pdf["trial"]):
                beta = contrasts(np.asarray(trial, dtype=float).reshape(k, p)) / scale
                beta[:, 0] -= beta[:, 1:] @ centre[1:]
                yield pd.DataFrame(
                    {
                        by: int(g),
                        "category": np.repeat(list(design.levels)[1:], p),
                        "term": terms * (k - 1),
                        "estimate": beta[1:].ravel(),
                    }
                )

    every = reduce(DataFrame.union, done).select(by, "trial")
    return every.mapInPandas(estimates, f"{by} int, {COEFFICIENT_SCHEMA}")
