"""One query per operator, over whole test tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymix import schema as S
from tallymix.functions.sizing import materialise, written
from tallymix.models import bootstrap, compare, estimator, fit, predict, splines
from tallymix.models.design import Design, to_cells
from tallymix.operators import (
    association,
    binning,
    cumulative,
    intervals,
    prep,
    quality,
    quantiles,
    reshape,
    share,
)
from tallymix.session import shared_dir
from tallymix.sources import tables
from tallymix.workloads import views as V

LEVELS = S.DESIGN_LEVELS
DRAWS = 50
FOLDS = 5
#: The number of draws the studies this library is for keep; the other queries take fewer.
MANY_DRAWS = 4_000

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that both engines print the same."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# Sources and sinks


@query
def load_studies(spark, d):
    return V.main_source(spark, d)


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query
def load_indicators(spark, d):
    path = fresh_path(spark, "indicators")
    tables.write_table(V.rd_wide(spark, d), path, "csv")
    return tidy(
        tables.read_csv(
            spark, path, S.indicator_schema(V.YEARS), {"name": "country_name", "code": "country_code"}
        )
    )


@query
def load_income(spark, d):
    """Income classes as a declared wide table of text, read back from CSV with its missing token."""
    path = fresh_path(spark, "income")
    tables.write_table(V.income_wide(spark, d), path, "csv")
    return tables.read_csv(spark, path, S.income_schema(V.YEARS))


@query
def load_prepared_studies(spark, d):
    """The central table kept as CSV with text for missing values, read as declared."""
    path = fresh_path(spark, "studies")
    tables.write_table(V.study(spark, d), path, "csv")
    return tidy(tables.read_csv(spark, path, S.STUDY))


@query
def table_head(spark, d):
    """The first rows of the central table by all of its columns."""
    rows = V.study(spark, d)
    return tidy(tables.head(rows, [F.col(c).asc_nulls_last() for c in rows.columns]))


@query
def write_summary(spark, d):
    path = fresh_path(spark, "summary")
    tables.write_table(share.composition(V.study(spark, d), "design", ["synopsis"]), path, "csv")
    return tidy(
        tables.read_csv(
            spark, path, T.StructType.fromDDL("synopsis string, design string, n long, share double")
        )
    )


@query
def profile_table(spark, d):
    return tidy(quality.profile(V.study(spark, d), ["year", "lat", "long"]))


# Projections, casts, recodes


@query
def project_studies(spark, d):
    return prep.project(
        V.second_source(spark, d),
        {"study_id": "paper_id", "design_raw": "Study_design", "year_raw": "Year", "country": "Country"},
    )


@query
def union_studies(spark, d):
    return tidy(V.study(spark, d))


@query
def coerce_numeric(spark, d):
    out = prep.coerce_numeric(
        V.main_source(spark, d),
        {"year": ("year_raw", "int"), "lat": ("lat_raw", "double"), "long": ("long_raw", "double")},
    )
    return tidy(out.select("study_id", "year", "lat", "long"))


@query
def recode_category(spark, d):
    partial = {"Paired BACI": "BACI", "Paired RCT": "RCT", "Paired R-BACI": "R-BACI"}
    out = prep.recode_category(V.main_source(spark, d), "design_raw", partial, "design")
    return share.count_by(out, ["design_raw", "design"])


@query
def ordered_domain(spark, d):
    out = prep.ordered_domain(V.study(spark, d), "design", ["BA", "CI", "BACI"], "design_rank")
    return share.count_by(out, ["design", "design_rank"])


@query
def levels_present(spark, d):
    return prep.levels_present(V.study(spark, d), "design", ["Unseen", *LEVELS])


@query
def relevel(spark, d):
    out = prep.relevel(V.study(spark, d), "design", LEVELS, "BACI")
    return share.count_by(out, ["design", "level_rank"])


@query
def reversed_labels(spark, d):
    return prep.reversed_labels(V.study(spark, d), "synopsis")


@query
def normalise_missing(spark, d):
    out = prep.normalise_missing(V.main_source(spark, d), ["lat_raw"])
    return out.select("study_id", F.col("lat_raw").isNull().alias("lat_missing")).groupBy(
        "study_id", "lat_missing"
    ).agg(F.count("*").alias("n"))


@query
def derived_indicator(spark, d):
    return tidy(V.rd_expenditure(spark, d).select("name", "code", "year", "rd_pc"))


@query
def income_group(spark, d):
    return share.count_by(V.with_income(spark, d), ["income_category", "income_group"])


# Filters


@query
def complete_rows(spark, d):
    return tidy(V.located(spark, d))


@query
def filter_equal(spark, d):
    rest = prep.filter_equal(V.study(spark, d), "synopsis", S.SECOND_SOURCE_SYNOPSIS, negate=True)
    return tidy(prep.filter_equal(rest, "continent", "EUROPE"))


@query
def year_range(spark, d):
    return tidy(prep.value_range(V.study(spark, d), "year", 1996, 1999))


@query
def consistent_multi_group(spark, d):
    return quality.consistent_multi_group(V.study(spark, d), "study_id", "synopsis", "design")


@query
def keep_listed(spark, d):
    rows = V.study(spark, d)
    ids = quality.multi_category_ids(rows, "study_id", "synopsis")
    return tidy(quality.keep_listed(rows, ids, ["study_id"]))


@query
def drop_listed(spark, d):
    rows = V.study(spark, d)
    found = quality.diversity(rows, "country", "study_id")
    thin = found.filter(F.col("n_categories") < found.agg(F.avg("n_categories")).scalar())
    return share.count_by(quality.drop_listed(rows, thin, ["country"]), ["country"])


@query
def coverage_filter(spark, d):
    return tidy(quality.coverage_filter(V.study(spark, d), "study_id", "design", 5))


@query
def coverage_filter_country(spark, d):
    """Groups with a NULL key: kept or dropped like any other group."""
    return share.count_by(quality.coverage_filter(V.study(spark, d), "country", "design", 5), ["country"])


@query
def multi_category_ids(spark, d):
    return quality.multi_category_ids(V.study(spark, d), "study_id", "design")


@query
def lowest_coverage(spark, d):
    return quality.lowest_coverage(V.study(spark, d), "study_id", "design", 20)


# Joins


@query
def join_indicators(spark, d):
    return tidy(V.rd_gdp(spark, d))


@query
def join_third_indicator(spark, d):
    return tidy(V.indicators(spark, d))


@query
def attach_indicators(spark, d):
    return tidy(V.merged(spark, d))


@query
def attach_income(spark, d):
    return tidy(V.with_income(spark, d).drop("income_group"))


@query
def covariate_grid(spark, d):
    return predict.covariate_grid(V.study(spark, d), "synopsis", "year")


@query
def standardise_names(spark, d):
    return share.count_by(V.coded_study(spark, d), ["country", "iso3c"])


@query
def unmatched_names(spark, d):
    coded = V.coded_study(spark, d)
    return prep.distinct_values(
        coded.filter(F.col("iso3c").isNull() & F.col("country").isNotNull()), ["country"]
    )


@query
def unmatched_income(spark, d):
    rows = prep.complete_rows(V.coded_study(spark, d), ["iso3c", "year"])
    known = prep.complete_rows(V.income_long(spark, d), ["income_category"])
    return quality.unmatched(rows, known, ["iso3c", "year"], ["iso3c", "country", "year"])


@query
def codes_missing_left(spark, d):
    return quality.key_difference(
        V.coded_study(spark, d), V.indicators(spark, d).withColumnRenamed("code", "iso3c"), "iso3c"
    )


@query
def codes_missing_right(spark, d):
    return quality.key_difference(
        V.indicators(spark, d).withColumnRenamed("code", "iso3c"), V.coded_study(spark, d), "iso3c"
    )


# Aggregations


@query
def count_by_keys(spark, d):
    return share.count_by(V.study(spark, d), ["year", "synopsis", "design"])


@query
def designs_by_year(spark, d):
    return quality.diversity(V.study(spark, d), "year", "design")


@query
def designs_by_group(spark, d):
    return quality.diversity(V.study(spark, d), "synopsis", "country", "n_countries")


@query
def designs_by_country(spark, d):
    return quality.diversity(V.coded_study(spark, d), "iso3c", "design")


@query
def distinct_studies(spark, d):
    return quality.distinct_counts(
        V.study(spark, d), ["study_id", "synopsis", "design", "year", "country", "continent"]
    )


@query
def share_overall(spark, d):
    return tidy(share.share_of_distinct(V.study(spark, d), "design", "study_id", LEVELS))


@query
def share_subset(spark, d):
    rows = prep.filter_equal(V.study(spark, d), "synopsis", S.SECOND_SOURCE_SYNOPSIS)
    return tidy(share.share_of_distinct(rows, "design", "study_id", LEVELS))


@query
def share_complement(spark, d):
    rows = prep.filter_equal(V.study(spark, d), "synopsis", S.SECOND_SOURCE_SYNOPSIS, negate=True)
    return tidy(share.share_of_distinct(rows, "design", "study_id", LEVELS))


@query
def share_by_continent(spark, d):
    return tidy(share.share_of_distinct(V.located(spark, d), "continent", "study_id", V.CONTINENTS))


@query
def share_by_country(spark, d):
    """The same without closed levels."""
    return tidy(share.share_of_distinct(V.study(spark, d), "country", "study_id"))


@query
def pct_continent(spark, d):
    rows = prep.complete_rows(V.study(spark, d), ["continent"])
    out = share.composition(rows, "continent", scale=100, name="percentage")
    return tidy(out.orderBy(F.col("percentage").desc()))


@query
def pct_design_in_continent(spark, d):
    rows = prep.complete_rows(V.study(spark, d), ["continent"])
    out = share.composition(rows, "design", ["continent"], scale=100, name="percentage")
    return tidy(out.orderBy(F.col("continent").asc_nulls_last(), F.col("percentage").desc()))


@query
def pct_design_global(spark, d):
    rows = prep.complete_rows(V.study(spark, d), ["continent"])
    return tidy(share.composition(rows, "design", scale=100, name="percentage"))


@query
def prop_design_in_continent(spark, d):
    return tidy(
        share.composition(
            V.located(spark, d), "design", ["continent"], distinct_id="study_id", n="n_studies",
            name="proportion",
        )
    )


@query
def composition_by_synopsis(spark, d):
    return tidy(
        share.composition(
            V.study(spark, d), "design", ["synopsis"], n="n_studies", name="proportion",
            total="total_studies",
        )
    )


@query
def binned_composition(spark, d):
    rows = binning.bin_steps(
        V.study(spark, d), "year", 1985, 2000, 5, "year_bin", close_last=True, suffix="-"
    )
    return tidy(share.composition(rows, "design", ["year_bin"], name="proportion"))


@query
def group_order(spark, d):
    mix = share.composition(V.study(spark, d), "design", ["synopsis"])
    return tidy(share.group_order(mix, "synopsis", "design", "After"))


def grid_rows(spark, d):
    return binning.bin_grid(V.located(spark, d), [("lat", "lat_bin"), ("long", "long_bin")], 6)


@query
def grid_counts(spark, d):
    return binning.grid_counts(grid_rows(spark, d), ["lat_bin", "long_bin"], "design")


@query
def grid_counts_distinct(spark, d):
    return binning.grid_counts(
        grid_rows(spark, d), ["lat_bin", "long_bin"], "design", distinct_id="study_id"
    )


@query
def median_interval(spark, d):
    return tidy(intervals.median_interval(V.draws_like(spark, d), ["synopsis", "design"], "epred"))


@query
def median_interval_large(spark, d):
    """Quantiles of whole tables: groups of tens of thousands of rows and more."""
    lines = spark.read.schema("l_returnflag string, l_extendedprice double").parquet(
        f"{d}/lineitem.parquet"
    )
    return tidy(
        quantiles.group_quantiles(
            lines, ["l_returnflag"], "l_extendedprice", {"lower": 0.025, "point": 0.5, "upper": 0.975}
        )
    )


@query
def row_counts(spark, d):
    return quality.row_counts(
        {
            "study": V.study(spark, d),
            "located": V.located(spark, d),
            "merged": V.merged(spark, d),
            "model": V.model_table(spark, d),
        }
    )


@query
def contingency(spark, d):
    return association.contingency(
        V.grouped_income(spark, d), "design", "income_group", ["High income", "Low/Middle income"]
    )


@query
def pearson_residuals(spark, d):
    return tidy(association.pearson_residuals(V.grouped_income(spark, d), "design", "income_group"))


@query
def chi_squared(spark, d):
    return tidy(association.chi_squared(V.grouped_income(spark, d), "design", "income_group"))


@query
def residual_matrix(spark, d):
    return tidy(association.residual_matrix(V.grouped_income(spark, d), "design", "income_group"))


@query
def standardise(spark, d):
    return tidy(
        V.model_table(spark, d).select("study_id", "iso3c", "year", "rd_pc_scaled", "ge_scaled"), 5
    )


@query
def empirical_logit_decade(spark, d):
    rows = binning.bin_steps(V.study(spark, d), "year", 1981, 2001, 10, "year_bin")
    counts = share.count_by(rows, ["year_bin", "design"])
    return tidy(reshape.empirical_logit(counts, "year_bin", "design", LEVELS, "After"))


def logit_by_bin(spark, d, predictor, into):
    rows = binning.bin_quantile(V.model_table(spark, d), predictor, 10, into)
    counts = share.count_by(rows, [into, "design"])
    return tidy(reshape.empirical_logit(counts, into, "design", LEVELS, "After"))


@query
def empirical_logit_quantile(spark, d):
    return logit_by_bin(spark, d, "rd_pc_scaled", "rd_bin")


@query
def empirical_logit_quantile_ge(spark, d):
    """The same for the second predictor, government effectiveness."""
    return logit_by_bin(spark, d, "ge_scaled", "ge_bin")


@query
def pivot_fill(spark, d):
    """Long to wide with 1 for absent cells: one row per entity, so many cells are absent."""
    counts = share.count_by(V.study(spark, d), ["study_id", "design"])
    return reshape.widen(counts, "study_id", "design", LEVELS, fill=1)


# Windows


@query
def complete_grid(spark, d):
    counts = share.count_by(V.study(spark, d), ["year", "country"])
    wanted = [f"NATION_{i}" for i in range(26)]
    return cumulative.complete_grid(counts, "year", "country", wanted)


@query
def cumulative_counts(spark, d):
    return cumulative.cumulative_counts(V.study(spark, d), "design", "year", LEVELS)


@query
def cumulative_share(spark, d):
    return tidy(cumulative.cumulative_share(V.study(spark, d), "design", "year", LEVELS))


def cumulative_places(spark, d):
    rows = prep.complete_rows(V.study(spark, d), ["continent"])
    return cumulative.cumulative_distinct(
        rows, "design", "year", {"cum_countries": "country", "cum_continents": "continent"}
    )


@query
def cumulative_distinct(spark, d):
    return cumulative_places(spark, d)


@query
def cumulative_distinct_studies(spark, d):
    """The same for a value with many distinct entries."""
    return cumulative.cumulative_distinct(
        V.study(spark, d), "synopsis", "year", {"cum_studies": "study_id"}
    )


@query
def cumulative_max(spark, d):
    return cumulative.cumulative_max(cumulative_places(spark, d), ["cum_countries", "cum_continents"])


# Sets, reshape, bins, labels


@query
def distinct_labels(spark, d):
    return prep.distinct_values(V.study(spark, d), ["continent", "country", "design"])


@query
def unpivot_indicators(spark, d):
    return tidy(V.indicator_long(V.rd_wide(spark, d), "rd_percent"))


@query
def unpivot_income(spark, d):
    return V.income_long(spark, d)


@query
def bin_decade(spark, d):
    rows = binning.bin_steps(V.study(spark, d), "year", 1981, 2001, 10, "year_bin")
    return share.count_by(rows, ["year_bin", "year"])


@query
def bin_five_year(spark, d):
    rows = binning.bin_steps(
        V.study(spark, d), "year", 1985, 2000, 5, "year_bin", close_last=True, suffix="-"
    )
    return share.count_by(rows, ["year_bin", "year"])


@query
def bin_quantile(spark, d):
    rows = binning.bin_quantile(V.model_table(spark, d), "rd_pc_scaled", 10, "rd_bin")
    return share.count_by(rows, ["rd_bin", "iso3c", "year"])


@query
def bin_quantile_ge(spark, d):
    rows = binning.bin_quantile(V.model_table(spark, d), "ge_scaled", 10, "ge_bin")
    return share.count_by(rows, ["ge_bin", "iso3c", "year"])


@query
def bin_grid(spark, d):
    return grid_rows(spark, d).select("study_id", "lat_bin", "long_bin")


@query
def shorten_labels(spark, d):
    part = V.table(spark, d, "part")
    topic = F.initcap("p_name")
    label = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Management of "), topic, F.lit(" and Freshwater Conservation in "), "p_brand"))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("Mediterranean "), topic, F.lit(" Conservation"), F.lit(" and "), "p_brand"))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("Artificial "), topic, F.lit(" and Invasive Species")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("Biodiversity of "), topic, F.lit(" and Invertebrate Conservation")))
        .when(F.col("p_type") == "STANDARD", F.concat(F.lit("Sustainable "), topic, F.lit(" Conservation")))
        .otherwise(F.concat(F.lit("Non-English "), topic))
    )
    named = part.withColumn("label", label).groupBy("label").agg(F.count("*").alias("n"))
    return prep.shorten_labels(named, "label", S.LABEL_RULES, "short_label")


# Models


def temporal(spark, d) -> tuple[DataFrame, Design]:
    rows = prep.complete_rows(V.study(spark, d), ["year", "design"])
    return rows, Design("design", LEVELS, ["year"], {"synopsis": V.SYNOPSES})


def geographic(spark, d) -> tuple[DataFrame, Design]:
    return V.model_table(spark, d), Design("design", LEVELS, ["rd_pc_scaled", "ge_scaled"])


def by_synopsis(spark, d) -> tuple[DataFrame, Design]:
    """A model with one parameter per observed share: its fit can be written in SQL."""
    return V.study(spark, d), Design("design", LEVELS, [], {"synopsis": V.SYNOPSES})


def fitted(spark, d, model=temporal, prior_sd=fit.PRIOR_SD):
    """Cells, draws and design of a model; the draws are stored once for their readers."""
    rows, design = model(spark, d)
    rows = materialise(rows.select("study_id", *design.covariates, design.category))
    cells = materialise(to_cells(rows, design))
    draws = bootstrap.multinomial_draws(rows, "study_id", design, DRAWS, prior_sd)
    return cells, materialise(draws), design


@query
def multinomial_fit(spark, d):
    rows, design = temporal(spark, d)
    return tidy(fit.multinomial_fit(materialise(to_cells(rows, design)), design), 4)


@query
def multinomial_fit_geography(spark, d):
    rows, design = geographic(spark, d)
    return tidy(fit.multinomial_fit(materialise(to_cells(rows, design)), design), 4)


def moments(rows, design, draws_of, centre, draws=DRAWS):
    """The sums that a model's fits claim for the data, by draw."""
    cells = written(draws_of(rows, design), "moment-cells")
    fits = fit.fit_groups(cells, "draw", draws, design, "n", fit.PRIOR_SD)
    return tidy(predict.fitted_moments(cells, fits, design, fit.PRIOR_SD, centre))


def one_draw(rows, design):
    return to_cells(rows, design).withColumn("draw", F.lit(1))


def all_draws(rows, design):
    return bootstrap.bootstrap_cells(design.check(rows), "study_id", [*design.covariates, design.category], DRAWS)


@query
def multinomial_fit_moments(spark, d):
    """The penalised fit by its first-order conditions: its sums are those of the data."""
    return moments(*temporal(spark, d), one_draw, {"year": 1998})


@query
def multinomial_fit_geography_moments(spark, d):
    return moments(*geographic(spark, d), one_draw, {})


@query
def multinomial_draws_moments(spark, d):
    return moments(*temporal(spark, d), all_draws, {"year": 1998})


NESTED = ["country", "study_id"]


@query
def bootstrap_cells_nested(spark, d):
    """Rows of a country, and rows of a study, move together: the weights multiply."""
    rows, design = temporal(spark, d)
    return bootstrap.bootstrap_cells(rows, NESTED, [*design.covariates, design.category], DRAWS)


@query
def multinomial_draws_nested_moments(spark, d):
    """Draws of the geographic model under both groupings, by their first-order conditions."""
    rows, design = geographic(spark, d)

    def draws_of(rows, design):
        return bootstrap.bootstrap_cells(design.check(rows), ["iso3c", "study_id"], [*design.covariates, design.category], DRAWS)

    return moments(rows, design, draws_of, {})


@query
def multinomial_many_draws_moments(spark, d):
    """As many draws as the studies keep, each by its first-order conditions."""
    rows, design = temporal(spark, d)
    rows = materialise(rows.select("study_id", *design.covariates, design.category))

    def draws_of(rows, design):
        keys = [*design.covariates, design.category]
        return bootstrap.bootstrap_cells(design.check(rows), "study_id", keys, MANY_DRAWS)

    return moments(rows, design, draws_of, {"year": 1998}, MANY_DRAWS)


@query
def epred_draws_moments(spark, d):
    """Expected rows per draw, subfield and category: probabilities over the grid times the rows there."""
    rows, design = temporal(spark, d)
    cells = written(all_draws(rows, design), "moment-cells")
    fits = fit.fit_groups(cells, "draw", DRAWS, design, "n", fit.PRIOR_SD)
    grid = predict.covariate_grid(cells, "synopsis", "year")
    epred = predict.epred_draws(grid, written(fits, "moment-fits"), design, DRAWS)
    weights = cells.groupBy("draw", "synopsis", "year").agg(F.sum("n").alias("n"))
    expected = epred.join(weights, ["draw", "synopsis", "year"]).groupBy("draw", "design")
    return tidy(expected.agg(F.sum(F.col("n") * F.col("epred")).alias("expected")))


@query
def multinomial_fit_saturated(spark, d):
    rows, design = by_synopsis(spark, d)
    cells = materialise(to_cells(rows, design))
    return tidy(fit.multinomial_fit(cells, design, prior_sd=None))


@query
def spline_features(spark, d):
    rows = prep.complete_rows(V.study(spark, d), ["lat"])
    return tidy(splines.spline_features(rows.select("study_id", "lat"), "lat", "lat_spline"))


@query
def bootstrap_cells(spark, d):
    rows, design = temporal(spark, d)
    return bootstrap.bootstrap_cells(
        rows, "study_id", [*design.covariates, design.category], DRAWS
    )


@query
def multinomial_draws(spark, d):
    rows, design = temporal(spark, d)
    return tidy(bootstrap.multinomial_draws(rows, "study_id", design, DRAWS), 4)


@query
def multinomial_draws_saturated(spark, d):
    rows, design = by_synopsis(spark, d)
    return tidy(bootstrap.multinomial_draws(rows, "study_id", design, DRAWS, prior_sd=None))


@query
def epred_draws(spark, d):
    cells, draws, design = fitted(spark, d)
    grid = predict.covariate_grid(cells, "synopsis", "year")
    return tidy(predict.epred_draws(grid, draws, design, DRAWS))


@query
def epred_draws_saturated(spark, d):
    rows, design = by_synopsis(spark, d)
    draws = bootstrap.multinomial_draws(rows, "study_id", design, DRAWS, prior_sd=None)
    grid = prep.distinct_values(rows, ["synopsis"])
    epred = predict.epred_draws(grid, materialise(draws), design, DRAWS)
    return tidy(epred.select("synopsis", "draw", "design", F.ln("epred").alias("log_epred")))


@query
def coefficient_summary_saturated(spark, d):
    _, draws, _ = fitted(spark, d, by_synopsis, prior_sd=None)
    return tidy(predict.coefficient_summary(draws))


@query
def predictive_check_saturated(spark, d):
    cells, draws, design = fitted(spark, d, by_synopsis, prior_sd=None)
    return tidy(predict.predictive_check(cells, draws, design, DRAWS))


@query
def predictive_check_replicated_saturated(spark, d):
    """Bands that hold sampling noise: each cell's rows are drawn anew in every draw."""
    cells, draws, design = fitted(spark, d, by_synopsis, prior_sd=None)
    return tidy(predict.predictive_check(cells, draws, design, DRAWS, seed="check"))


@query
def predictive_check_replicated(spark, d):
    cells, draws, design = fitted(spark, d)
    return tidy(predict.predictive_check(cells, draws, design, DRAWS, ["synopsis"], seed="check"))


@query
def elpd_compare_saturated(spark, d):
    rows, by_group = by_synopsis(spark, d)
    models = {"by_group": by_group, "overall": Design("design", LEVELS)}
    return tidy(compare.elpd_compare(materialise(rows), "study_id", models, FOLDS, prior_sd=None))


@query
def elpd_loo_saturated(spark, d):
    """Left-out studies by one Newton step, in models whose step can be written in SQL."""
    rows, by_group = by_synopsis(spark, d)
    rows = materialise(rows.select("study_id", *by_group.covariates, "design"))
    models = {"by_group": by_group, "overall": Design("design", LEVELS)}
    return tidy(compare.elpd_loo(rows, "study_id", models, prior_sd=None))


@query
def elpd_loo(spark, d):
    """Linear against curved in the year."""
    rows, linear = temporal(spark, d)
    rows = materialise(rows.select("study_id", *linear.covariates, "design"))
    rows = splines.spline_features(rows, "year", "year_spline")
    curved = Design("design", LEVELS, ["year", "year_spline"], {"synopsis": V.SYNOPSES})
    return tidy(compare.elpd_loo(rows, "study_id", {"linear": linear, "spline": curved}))


@query
def conditional_curve(spark, d):
    cells, draws, design = fitted(spark, d)
    return tidy(predict.conditional_curve(cells, draws, design, "year", DRAWS))


@query
def conditional_curve_geography(spark, d):
    cells, draws, design = fitted(spark, d, geographic)
    return tidy(predict.conditional_curve(cells, draws, design, "rd_pc_scaled", DRAWS))


@query
def conditional_curve_ge(spark, d):
    cells, draws, design = fitted(spark, d, geographic)
    return tidy(predict.conditional_curve(cells, draws, design, "ge_scaled", DRAWS))


@query
def average_slope(spark, d):
    cells, draws, design = fitted(spark, d)
    return tidy(predict.average_slope(cells, draws, design, "year", DRAWS))


@query
def averaged_probability(spark, d):
    averaged = intervals.averaged_probability(V.draws_like(spark, d), "synopsis", "draw", "design")
    return tidy(averaged, 9)


@query
def grand_mean(spark, d):
    averaged = intervals.averaged_probability(V.draws_like(spark, d), "synopsis", "draw", "design")
    return tidy(intervals.grand_mean(averaged, "draw", "design"), 9)


@query
def group_vs_grand_mean(spark, d):
    averaged = intervals.averaged_probability(V.draws_like(spark, d), "synopsis", "draw", "design")
    return tidy(
        intervals.group_vs_grand_mean(averaged, "synopsis", "draw", "design", bounded=False), 9
    )


@query
def group_vs_grand_mean_model(spark, d):
    """The same on the draws of the temporal model."""
    cells, draws, design = fitted(spark, d)
    grid = predict.covariate_grid(cells, "synopsis", "year")
    epred = predict.epred_draws(grid, draws, design, DRAWS)
    averaged = intervals.averaged_probability(epred, "synopsis", "draw", "design")
    return tidy(intervals.group_vs_grand_mean(averaged, "synopsis", "draw", "design"))


@query
def elpd_compare(spark, d):
    rows, linear = temporal(spark, d)
    rows = splines.spline_features(materialise(rows), "year", "year_spline")
    curved = Design("design", LEVELS, ["year", "year_spline"], {"synopsis": V.SYNOPSES})
    return tidy(
        compare.elpd_compare(rows, "study_id", {"linear": linear, "spline": curved}, FOLDS), 3
    )


@query
def coefficient_summary(spark, d):
    _, draws, _ = fitted(spark, d)
    return tidy(predict.coefficient_summary(draws), 4)


@query
def predictive_check(spark, d):
    cells, draws, design = fitted(spark, d)
    return tidy(predict.predictive_check(cells, draws, design, DRAWS, ["synopsis"]))


@query
def vif(spark, d):
    return tidy(predict.variance_inflation(V.model_table(spark, d), ["rd_pc_scaled", "ge_scaled"]))


@query
def keep_fit(spark, d):
    rows, design = geographic(spark, d)
    cells = materialise(to_cells(rows, design))
    point = fit.multinomial_fit(cells, design)
    draws = bootstrap.multinomial_draws(rows, "iso3c", design, DRAWS)
    path = fresh_path(spark, "fit")
    tables.save_fit(point, draws, path)
    point, draws = tables.load_fit(spark, path)
    return tidy(
        predict.coefficient_summary(draws)
        .join(point.withColumnRenamed("estimate", "point_estimate"), ["category", "term"])
        .select("category", "term", "point_estimate", "conf_low", "conf_high"),
        3,
    )


@query
def keep_fit_saturated(spark, d):
    """A model written, read back and asked for the probabilities of every subfield."""
    rows, design = by_synopsis(spark, d)
    model = estimator.Multinomial(design, prior_sd=None).fit(materialise(to_cells(rows, design)))
    path = fresh_path(spark, "model")
    model.write().save(path)
    found = estimator.MultinomialModel.load(path).transform(prep.distinct_values(rows, ["synopsis"]))
    each = [F.struct(F.lit(v).alias("design"), F.ln(F.col("probability")[i]).alias("log_probability")) for i, v in enumerate(LEVELS)]
    return tidy(found.select("synopsis", F.inline(F.array(*each))))


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)
