"""Designs over places: shares, indicators, model, map counts and income groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix import schema as S
from tallymix.functions.sizing import materialise
from tallymix.models import bootstrap, compare, predict, splines
from tallymix.models.design import Design, to_cells
from tallymix.operators import association, binning, cumulative, linkage, prep, quality, reshape, share

# Map cell in degrees, and the years with income classes.
GRID_DEGREES = 6
INCOME_YEARS = (1987, 2024)


def continent_shares(study: DataFrame) -> dict[str, DataFrame]:
    """Percentages of rows, and shares of distinct studies, by continent and design."""
    placed = prep.complete_rows(study, ["continent"])
    located = prep.complete_rows(study, ["lat", "long", "continent"])
    pct = {"scale": 100.0, "name": "percentage"}
    return {
        "pct_continent": share.composition(placed, "continent", **pct),
        "pct_design_in_continent": share.composition(placed, "design", ["continent"], **pct),
        "pct_design": share.composition(placed, "design", **pct),
        "share_by_continent": share.share_of_distinct(located, "continent", "study_id"),
        "share_by_design": share.share_of_distinct(located, "design", "study_id", S.DESIGN_LEVELS),
        "prop_in_continent": share.composition(
            located, "design", ["continent"], distinct_id="study_id", n="n_studies", name="proportion"
        ),
    }


def indicator_table(
    rd: DataFrame, gdp: DataFrame, ge: DataFrame, year_columns: Sequence[str], prefix: str = "X"
) -> DataFrame:
    """Research spending per head and effectiveness per (country, year).

    The first two tables meet on (code, year), the third on (name, year).
    """

    def long(wide, name):
        return reshape.lengthen_years(wide, ["name", "code"], year_columns, name, prefix)

    both = linkage.join_indicators(
        long(rd, "rd_percent"), long(gdp, "gdp_pc").select("code", "year", "gdp_pc"), ["code", "year"]
    )
    spent = linkage.derived_indicator(both, "rd_percent", "gdp_pc", "rd_pc")
    return linkage.join_indicators(
        spent.select("name", "code", "year", "rd_pc"),
        long(ge, "ge").select("name", "year", "ge"),
        ["name", "year"],
    )


def linked(
    study: DataFrame, crosswalk: DataFrame, indicators: DataFrame,
    overrides: Mapping[str, str | None] = S.NAME_OVERRIDES,
) -> dict[str, DataFrame]:
    """Coded rows, rows with indicators, complete scaled rows, and the keys left over."""
    coded = linkage.standardise_names(study, "country", crosswalk, overrides)
    dim = indicators.withColumnRenamed("code", "iso3c")
    merged = linkage.attach(coded, dim.select("iso3c", "year", "rd_pc", "ge"), ["iso3c", "year"])
    complete = materialise(prep.complete_rows(merged, ["rd_pc", "ge"]))
    return {
        "coded": coded,
        "merged": merged,
        "model_rows": linkage.standardise(complete, ["rd_pc", "ge"]),
        "unmatched_names": prep.distinct_values(
            coded.filter(F.col("iso3c").isNull() & F.col("country").isNotNull()), ["country"]
        ),
        "designs_by_country": quality.diversity(coded, "iso3c", "design"),
        "codes_without_indicator": quality.key_difference(coded, dim, "iso3c"),
        "codes_without_study": quality.key_difference(dim, coded, "iso3c"),
    }


def model(
    rows: DataFrame, cluster: str | Sequence[str] = ("iso3c", "study_id"), n_draws: int = 200
) -> dict[str, DataFrame]:
    """design ~ spending + effectiveness; rows of a country, and of a study, move together."""
    names = ["rd_pc_scaled", "ge_scaled"]
    clusters = [cluster] if isinstance(cluster, str) else list(cluster)
    compared = linear_or_spline(rows)
    logits = {f"logit_{x}": logit_by_bin(rows, x) for x in names}
    rows = materialise(rows.select(*dict.fromkeys([*clusters, "design", *names])))
    design = Design("design", S.DESIGN_LEVELS, names)
    cells = materialise(to_cells(rows, design))
    draws = materialise(bootstrap.multinomial_draws(rows, cluster, design, n_draws))
    curves = {
        f"curve_{x}": predict.conditional_curve(cells, draws, design, x, n_draws) for x in names
    }
    return {
        "coefficients": predict.coefficient_summary(draws),
        "check": predict.predictive_check(cells, draws, design, n_draws, seed="check"),
        "vif": predict.variance_inflation(rows, names),
        "linear_or_spline": compared,
        **logits,
        **curves,
    }


def linear_or_spline(rows: DataFrame, study: str = "study_id") -> DataFrame:
    """Leave-one-study-out score of the linear model against splines in both predictors."""
    names = ["rd_pc_scaled", "ge_scaled"]
    rows = materialise(rows.select(study, "design", *names))
    curves = [f"{x}_spline" for x in names]
    for x, into in zip(names, curves):
        rows = splines.spline_features(rows, x, into)
    models = {
        "linear": Design("design", S.DESIGN_LEVELS, names),
        "spline": Design("design", S.DESIGN_LEVELS, [*names, *curves]),
    }
    return compare.elpd_loo(rows, study, models)


def logit_by_bin(rows: DataFrame, predictor: str, bins: int = 10) -> DataFrame:
    """Log ratios of each design to the first, over equal-count bins of a predictor."""
    binned = binning.bin_quantile(rows, predictor, bins, "bin")
    counts = share.count_by(binned, ["bin", "design"])
    return reshape.empirical_logit(counts, "bin", "design", S.DESIGN_LEVELS, S.DESIGN_LEVELS[0])


def map_counts(study: DataFrame, cell: float = GRID_DEGREES) -> DataFrame:
    located = prep.complete_rows(study, ["lat", "long", "continent"])
    binned = binning.bin_grid(located, [("lat", "lat_bin"), ("long", "long_bin")], cell)
    return binning.grid_counts(binned, ["lat_bin", "long_bin"], "design")


def places_over_time(coded: DataFrame) -> dict[str, DataFrame]:
    """Countries and continents met so far per design, and the most any design reaches."""
    counts = {"cum_countries": "iso3c", "cum_continents": "continent"}
    curves = cumulative.cumulative_distinct(prep.complete_rows(coded, ["continent"]), "design", "year", counts)
    return {"places_over_time": curves, "most_places": cumulative.cumulative_max(curves, list(counts))}


def income_test(
    coded: DataFrame, income_wide: DataFrame, years: tuple[int, int] = INCOME_YEARS
) -> dict[str, DataFrame]:
    """Over- and under-representation of designs in income groups."""
    columns = [c for c in income_wide.columns if c not in ("iso3c", "name")]
    classes = reshape.lengthen_years(income_wide, ["iso3c", "name"], columns, "income_category")
    rows = prep.value_range(coded, "year", *years)
    joined = linkage.attach(rows, classes.select("iso3c", "year", "income_category"), ["iso3c", "year"])
    grouped = linkage.class_group(joined, "income_category", S.INCOME_GROUPS, "income_group")
    known = materialise(prep.complete_rows(grouped, ["income_group"]).select("design", "income_group"))
    groups = list(dict.fromkeys(S.INCOME_GROUPS.values()))
    without = grouped.filter(F.col("iso3c").isNotNull() & F.col("income_category").isNull())
    return {
        "missing_income": prep.distinct_values(without, ["iso3c", "country", "year"]),
        "contingency": association.contingency(known, "design", "income_group", groups),
        "residuals": association.pearson_residuals(known, "design", "income_group"),
        "test": association.chi_squared(known, "design", "income_group"),
        "residual_matrix": association.residual_matrix(known, "design", "income_group"),
    }


def analyse(
    study: DataFrame, crosswalk: DataFrame, indicators: DataFrame, income_wide: DataFrame,
    overrides: Mapping[str, str | None] = S.NAME_OVERRIDES, n_draws: int = 200,
    income_years: tuple[int, int] = INCOME_YEARS,
) -> dict[str, DataFrame]:
    """The whole chain over places, from the central table to the income test."""
    found = linked(study, crosswalk, indicators, overrides)
    coded = materialise(found["coded"])
    return {
        **continent_shares(study),
        **found,
        **model(found["model_rows"], n_draws=n_draws),
        "map_counts": map_counts(study),
        **places_over_time(coded),
        **income_test(coded, income_wide, income_years),
    }
