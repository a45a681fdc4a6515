"""Designs over time: checks, filters, model and subfield summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallymix import schema as S
from tallymix.functions.sizing import materialise
from tallymix.models import bootstrap, compare, predict, splines
from tallymix.models.design import Design, factor_levels, to_cells
from tallymix.operators import binning, intervals, prep, quality, reshape, share

# Years that have every design.
FIRST_YEAR, LAST_YEAR = 1981, 2020


def describe(study: DataFrame) -> dict[str, DataFrame]:
    """Shares of designs overall and by source, and studies with several designs."""
    other = S.SECOND_SOURCE_SYNOPSIS
    subset = prep.filter_equal(study, "synopsis", other)
    rest = prep.filter_equal(study, "synopsis", other, negate=True)
    several = quality.multi_category_ids(study, "study_id", "synopsis")
    return {
        "share_overall": share.share_of_distinct(study, "design", "study_id", S.DESIGN_LEVELS),
        "share_subset": share.share_of_distinct(subset, "design", "study_id", S.DESIGN_LEVELS),
        "share_complement": share.share_of_distinct(rest, "design", "study_id", S.DESIGN_LEVELS),
        "several_designs": quality.multi_category_ids(study, "study_id", "design"),
        "several_subfields": several,
        "consistent": quality.consistent_multi_group(study, "study_id", "synopsis", "design"),
        "designs_by_year": quality.diversity(study, "year", "design"),
    }


def modelled_rows(study: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """Rows in the year range, of subfields that have all designs in it."""
    rows = prep.value_range(study, "year", first, last)
    return quality.coverage_filter(rows, "synopsis", "design", len(S.DESIGN_LEVELS))


def logit_by_decade(rows: DataFrame, start: int = 1980, stop: int = 2020) -> DataFrame:
    binned = binning.bin_steps(rows, "year", start, stop, 10, "year_bin")
    counts = share.count_by(binned, ["year_bin", "design"])
    return reshape.empirical_logit(counts, "year_bin", "design", S.DESIGN_LEVELS, S.DESIGN_LEVELS[0])


def mix_by_five_years(rows: DataFrame, start: int = 1980, stop: int = 2020) -> DataFrame:
    binned = binning.bin_steps(rows, "year", start, stop, 5, "year_bin", close_last=True, suffix="-")
    return share.composition(binned, "design", ["year_bin"], name="proportion")


@dataclass(frozen=True)
class Fit:
    design: Design
    cells: DataFrame
    draws: DataFrame
    n_draws: int


def fit(rows: DataFrame, n_draws: int = 200) -> Fit:
    """design ~ year + synopsis, resampling whole studies."""
    rows = materialise(rows.select("study_id", "year", "synopsis", "design"))
    design = Design("design", S.DESIGN_LEVELS, ["year"], {"synopsis": factor_levels(rows, "synopsis")})
    cells = materialise(to_cells(rows, design))
    draws = materialise(bootstrap.multinomial_draws(rows, "study_id", design, n_draws))
    return Fit(design, cells, draws, n_draws)


def linear_or_spline(rows: DataFrame) -> DataFrame:
    """Leave-one-study-out score of the linear model against a spline in year."""
    rows = splines.spline_features(materialise(rows), "year", "year_spline")
    groups = {"synopsis": factor_levels(rows, "synopsis")}
    models = {
        "linear": Design("design", S.DESIGN_LEVELS, ["year"], groups),
        "spline": Design("design", S.DESIGN_LEVELS, ["year", "year_spline"], groups),
    }
    return compare.elpd_loo(rows, "study_id", models)


def subfields_against_mean(model: Fit) -> DataFrame:
    """Which subfields have more or less of a design than the average subfield."""
    grid = predict.covariate_grid(model.cells, "synopsis", "year")
    epred = predict.epred_draws(grid, model.draws, model.design, model.n_draws)
    averaged = materialise(intervals.averaged_probability(epred, "synopsis", "draw", "design"))
    out = intervals.group_vs_grand_mean(averaged, "synopsis", "draw", "design")
    return prep.shorten_labels(out, "synopsis", S.LABEL_RULES, "label")


def analyse(study: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, n_draws: int = 200):
    rows = materialise(modelled_rows(study, first, last))
    model = fit(rows, n_draws)
    return {
        **describe(study),
        "mix_by_five_years": mix_by_five_years(rows, first - 1, last),
        "logit_by_decade": logit_by_decade(rows, first - 1, last),
        "coefficients": predict.coefficient_summary(model.draws),
        "curve": predict.conditional_curve(model.cells, model.draws, model.design, "year", n_draws),
        "slope": predict.average_slope(model.cells, model.draws, model.design, "year", n_draws),
        "check": predict.predictive_check(model.cells, model.draws, model.design, n_draws, seed="check"),
        "linear_or_spline": linear_or_spline(rows),
        "subfields": subfields_against_mean(model),
    }
