"""Comparing two models by their cross-validated log score."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.functions.sizing import null_safe_join, written
from tallymix.models.design import Design
from tallymix.models.fit import PRIOR_SD, fit_groups, multinomial_fit
from tallymix.models.predict import by_category, over_draws, probabilities

# Numbers a task holds at once in each of its arrays of curvatures.
BLOCK = 1 << 20


def fold_of(cluster: str, folds: int) -> Column:
    """Fold 1..folds of a cluster; all its rows are held out together."""
    key = F.coalesce(F.col(cluster).cast("string"), F.lit("\\N"))
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return (h % folds + 1).cast("int")


def fold_cells(df: DataFrame, cluster: str, models: list[Design], folds: int) -> DataFrame:
    """Counts per (fold, covariates of all models, category)."""
    for m in models:
        df = m.check(df)
    covariates = list(dict.fromkeys(c for m in models for c in m.covariates))
    return (
        df.withColumn("fold", fold_of(cluster, folds))
        .groupBy("fold", *covariates, models[0].category)
        .agg(F.count("*").alias("n"))
    )


def held_out_scores(
    cells: DataFrame, design: Design, folds: int, name: str, prior_sd: float | None
) -> DataFrame:
    """Log probability of each held-out (fold, cell, category) under one model."""
    keys = [*design.covariates, design.category]
    others = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda f: f != F.col("fold"))
    training = (
        cells.withColumn("held_out", F.explode(others))
        .groupBy("held_out", *keys)
        .agg(F.sum("n").alias("n"))
    )
    fits = fit_groups(training, "held_out", folds, design, "n", prior_sd)
    fits = fits.withColumnRenamed("held_out", "draw")
    grid = cells.select(*design.covariates).distinct()
    return over_draws(grid, fits, design, folds).select(
        *design.covariates,
        F.col("draw").alias("fold"),
        F.inline(by_category(design, [F.ln(p) for p in probabilities(design)], name)),
    )


def elpd_compare(
    df: DataFrame,
    cluster: str,
    models: dict[str, Design],
    folds: int = 10,
    prior_sd: float | None = PRIOR_SD,
) -> DataFrame:
    """Models by held-out log score, best first, with the difference to the best.

    Scores are kept per (fold, cell, category) with the number of rows they stand for;
    the difference and sqrt(n var(d)) are weighted sums over these cells.
    """
    designs = list(models.values())
    cells = written(fold_cells(df, cluster, designs, folds), "fold-cells")
    scored = cells
    for name, design in models.items():
        keys = ["fold", *design.covariates, design.category]
        scores = held_out_scores(cells, design, folds, f"__{name}", prior_sd)
        scored = null_safe_join(scored, scores, keys)
    return ranked(scored, list(models), F.col("n"))


def ranked(scored: DataFrame, models: list[str], w: Column) -> DataFrame:
    """Models by the sum of their scores ``__<model>``, each row standing for ``w`` of them."""
    # All that is compared are sums over the cells: one evaluation, one row.
    pairs = [(a, b) for a in models for b in models]
    sums = scored.agg(
        F.sum(w).alias("rows"),
        *[F.sum(w * F.col(f"__{m}")).alias(f"e_{m}") for m in models],
        *[F.sum(w * (F.col(f"__{a}") - F.col(f"__{b}"))).alias(f"d_{a}_{b}") for a, b in pairs],
        *[F.sum(w * (F.col(f"__{a}") - F.col(f"__{b}")) ** 2).alias(f"q_{a}_{b}") for a, b in pairs],
    ).first()
    total = sums["rows"] or 0
    best = max(models, key=lambda m: sums[f"e_{m}"] if total else 0.0)
    out = []
    for m in models:
        d, q = sums[f"d_{m}_{best}"], sums[f"q_{m}_{best}"]
        spread = max(q - d * d / total, 0.0) if total else None
        out.append((m, sums[f"e_{m}"], d, math.sqrt(total * spread / (total - 1)) if total > 1 else None))
    out.sort(key=lambda r: (-(r[1] or 0.0), r[0]))
    frame = scored.sparkSession.createDataFrame(out, "model string, elpd double, elpd_diff double, se_diff double")
    return frame.coalesce(1)


class Local:
    """A design's likelihood near its optimum: residual sums and curvature of some cells.

    Parameters are the contrasts, category by category; numeric terms are taken about
    ``centre``, at which the intercepts in ``beta`` hold.
    """

    def __init__(self, design: Design, beta: np.ndarray, centre: np.ndarray, prior_sd: float | None):
        self.design, self.beta, self.centre = design, beta, centre
        k, p = len(design.levels) - 1, len(design.terms)
        free = np.eye(p)
        free[0, 0] = 0.0
        # The ridge acts on symmetric slopes: contrasts less their share of the mean.
        self.ridge = np.kron(np.eye(k) - 1.0 / (k + 1), free) * (0.0 if prior_sd is None else prior_sd**-2.0)

    def counts(self, pdf: pd.DataFrame, levels: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(model matrix, counts per category) of cells with columns __n0, __n1, .. for ``levels``."""
        x = self.design.matrix(pdf)
        x[:, 1 : len(self.centre) + 1] -= self.centre
        return x, pdf[[f"__n{levels.index(v)}" for v in self.design.levels]].to_numpy(dtype=float)

    def log_probabilities(self, eta: np.ndarray) -> np.ndarray:
        eta = np.column_stack([np.zeros(len(eta)), eta])
        eta -= eta.max(axis=1, keepdims=True)
        return eta - np.log(np.exp(eta).sum(axis=1, keepdims=True))

    def tiles(self, x: np.ndarray, y: np.ndarray, of: np.ndarray):
        """Some rows at a time: (x, y, groups that occur in them, where these begin). ``of`` rises."""
        tile = max(1, BLOCK // x.shape[1] ** 2)
        for at in range(0, len(x), tile):
            own = of[at : at + tile]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            yield x[at : at + tile], y[at : at + tile], own[first], first

    def sums(self, x: np.ndarray, y: np.ndarray, of: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """(gradient, curvature) of the log likelihood of the cells of each group 0, 1, .."""
        k, t = self.beta.shape
        gradient, curvature = np.zeros((groups, k, t)), np.zeros((groups, k, t, k, t))
        for xs, ys, which, first in self.tiles(x, y, of):
            p, w = np.exp(self.log_probabilities(xs @ self.beta.T))[:, 1:], ys.sum(axis=1)
            gradient[which] += np.add.reduceat((ys[:, 1:] - w[:, None] * p)[:, :, None] * xs[:, None, :], first)
            squares = xs[:, :, None] * xs[:, None, :]
            for a in range(k):
                for b in range(a, k):
                    block = np.add.reduceat(squares * (w * p[:, a] * ((a == b) - p[:, b]))[:, None, None], first)
                    curvature[which, a, :, b, :] += block
                    if a != b:
                        curvature[which, b, :, a, :] += block
        return gradient.reshape(groups, k * t), curvature.reshape(groups, k * t, k * t)

    def left_out(self, x: np.ndarray, y: np.ndarray, of: np.ndarray, groups: int, whole: np.ndarray) -> np.ndarray:
        """Log score of each group under the fit without it, by one Newton step from the full fit."""
        gradient, own = self.sums(x, y, of, groups)
        step = np.linalg.solve(whole + self.ridge - own, gradient[:, :, None])
        beta, scores = self.beta - step.reshape(groups, *self.beta.shape), np.zeros(groups)
        for xs, ys, which, first in self.tiles(x, y, of):
            each = np.repeat(beta[which], np.diff(first, append=len(xs)), axis=0)
            eta = (each @ xs[:, :, None])[:, :, 0]
            scores[which] += np.add.reduceat((ys * self.log_probabilities(eta)).sum(axis=1), first)
        return scores


def by_level(cells: DataFrame, keys: list[str], category: str, levels: list[str]) -> DataFrame:
    """One row per keys with the count of each category."""
    counts = [F.sum(F.when(F.col(category) == v, F.col("n")).otherwise(0)).alias(f"__n{i}") for i, v in enumerate(levels)]
    return cells.groupBy(*keys).agg(*counts)


def near_fit(cells: DataFrame, design: Design, prior_sd: float | None) -> tuple[Local, np.ndarray]:
    """The fit to all cells and its curvature, which Spark sums over the cells."""
    fits = multinomial_fit(cells.groupBy(*design.covariates, design.category).agg(F.sum("n").alias("n")), design, prior_sd=prior_sd)
    got = {(r["category"], r["term"]): r["estimate"] for r in fits.collect()}  # categories x terms
    beta = np.array([[got[c, t] for t in design.terms] for c in design.levels[1:]])
    means = cells.agg(F.sum("n"), *[F.sum(F.col("n") * F.col(c).cast("double")) for c in design.numeric]).first()
    centre = np.array([v / means[0] for v in means[1:]])
    beta[:, 0] += beta[:, 1 : len(centre) + 1] @ centre
    near, size, levels = Local(design, beta, centre, prior_sd), beta.size, list(design.levels)

    def curvatures(batches):
        total = np.zeros((size, size))
        for pdf in batches:
            total += near.sums(*near.counts(pdf, levels), np.zeros(len(pdf), dtype=int), 1)[1][0]
        yield pd.DataFrame({"i": np.arange(size), "v": list(total)})

    rows = by_level(cells, design.covariates, design.category, levels).mapInPandas(curvatures, "i int, v array<double>")
    rows = rows.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    whole = np.zeros((size, size))
    for r in rows.collect():  # parameters x parameters
        whole[r["i"], r["j"]] = r["v"]
    return near, whole


def whole_studies(batches):
    """Frames of whole studies, from batches in the order of ``__study``: a study may span batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        if held and held[-1]["__study"].iloc[-1] != pdf["__study"].iloc[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        codes = pd.factorize(pdf["__study"], use_na_sentinel=False)[0]
        last = int(np.argmax(codes == codes[-1]))
        if last:
            yield pd.concat([*held, pdf[:last]], ignore_index=True)
            held = []
        held.append(pdf[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def left_out_scores(cells: DataFrame, study: str, models: dict[str, Design], prior_sd: float | None) -> DataFrame:
    """(study, rows, a score per model): held-out log score of each study under the fit without it.

    One fit a model. A task takes the own sums of its studies off the curvature of the fit and
    makes one Newton step each, which is near the refit where no study rules the fit. Studies
    meet whole in sorted partitions and are stepped many at a time; a study is as many cells
    as it has covariate values, however many rows.
    """
    near = {name: near_fit(cells, design, prior_sd) for name, design in models.items()}
    levels = list(dict.fromkeys(v for m in models.values() for v in m.levels))
    widest = max(local.beta.size for local, _ in near.values())
    most = max(1, BLOCK // widest**2)

    def scored(batches):
        for pdf in whole_studies(batches):
            codes = pd.factorize(pdf["__study"], use_na_sentinel=False)[0]
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            ends = np.append(first, len(pdf))
            made = {name: (local, *local.counts(pdf, levels), whole) for name, (local, whole) in near.items()}
            for at in range(0, len(first), most):
                now = slice(ends[at], ends[min(at + most, len(first))])
                of, studies = codes[now] - at, min(most, len(first) - at)
                out = {"__study": pdf["__study"].iloc[first[at : at + most]].to_numpy()}
                for name, (local, x, y, whole) in made.items():
                    out["__rows"] = np.bincount(of, weights=y[now].sum(axis=1), minlength=studies).astype("int64")
                    out[name] = local.left_out(x[now], y[now], of, studies, whole)
                yield pd.DataFrame(out)

    covariates = list(dict.fromkeys(c for m in models.values() for c in m.covariates))
    spark = cells.sparkSession
    # An explicit number of tasks: by their bytes alone few would be left, and a cell is work for a task.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = cells.withColumn("__study", F.col(study).cast("string")).repartition(tasks, "__study")
    own = by_level(own, ["__study", *covariates], next(iter(models.values())).category, levels).sortWithinPartitions("__study")
    scores = ", ".join(f"{name} double" for name in models)
    return own.mapInPandas(scored, f"__study string, __rows bigint, {scores}")


def study_scores(cells: DataFrame, study: str, design: Design, prior_sd: float | None, name: str) -> DataFrame:
    """``left_out_scores`` of one model."""
    return left_out_scores(cells, study, {name: design}, prior_sd)


def elpd_loo(df: DataFrame, study: str, models: dict[str, Design], prior_sd: float | None = PRIOR_SD) -> DataFrame:
    """Models by approximate leave-one-study-out log score, best first.

    ``se_diff`` is that of a sum over studies: sqrt(S var(d)).
    """
    designs = list(models.values())
    for m in designs:
        df = m.check(df)
    covariates = list(dict.fromkeys(c for m in designs for c in m.covariates))
    cells = df.groupBy(study, *covariates, designs[0].category).agg(F.count("*").alias("n"))
    cells = written(cells, "study-cells")
    scores = left_out_scores(cells, study, {f"__{name}": m for name, m in models.items()}, prior_sd)
    return ranked(scores, list(models), F.lit(1))
