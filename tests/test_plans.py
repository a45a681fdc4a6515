"""The three analyses end to end, and the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tallymix import schema as S
from tallymix.functions.sizing import materialise
from tallymix.models import bootstrap
from tallymix.operators import cumulative, quantiles, share
from tallymix.plans import composition, geographic, temporal
from tallymix.workloads import catalogue as C
from tallymix.workloads import views as V

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    return materialise(V.study(spark, SF))


def test_composition(study):
    out = composition.analyse(study)
    sums = out["composition"].groupBy("synopsis").agg(F.sum("proportion").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    assert [r["position"] for r in out["order"].collect()] == list(range(1, len(sums) + 1))
    last = out["cumulative_share"].filter("year is null").agg(F.sum("cum_share")).first()[0]
    assert last == pytest.approx(1.0)


def test_temporal(study):
    out = temporal.analyse(study, 1996, 2001, n_draws=10)
    for name, df in out.items():
        assert df.count() > 0 or name == "consistent", name
    assert out["subfields"].count() == 6 * 5
    assert out["curve"].count() == 100 * 5


def test_modelled_rows_have_all_designs(study):
    rows = temporal.modelled_rows(study, 1996, 2000)
    per = rows.groupBy("synopsis").agg(F.count_distinct("design").alias("k"), F.min("year"), F.max("year"))
    assert all(r["k"] == 5 and r[2] >= 1996 and r[3] <= 2000 for r in per.collect())


def test_geographic(spark, study):
    cells = V.line_cells(spark, SF)
    dim = geographic.indicator_table(
        V.rd_wide(spark, SF), V.gdp_wide(spark, SF, cells), V.ge_wide(spark, SF, cells), V.YEAR_COLUMNS
    )
    link = geographic.linked(study, V.crosswalk(spark, SF), dim, V.NAME_OVERRIDES)
    assert link["merged"].count() == study.count()
    assert [r[0] for r in link["unmatched_names"].collect()] == ["NATION_21"]
    out = geographic.analyse(
        study, V.crosswalk(spark, SF), dim, V.income_wide(spark, SF), V.NAME_OVERRIDES, n_draws=10, income_years=(1995, 2001)
    )
    may_be_empty = {"codes_without_indicator"}
    assert all(df.count() > 0 or name in may_be_empty for name, df in out.items())
    assert [r["model"] for r in out["linear_or_spline"].orderBy(F.desc("elpd")).collect()] == [r["model"] for r in out["linear_or_spline"].collect()]
    assert out["curve_ge_scaled"].count() == 500 and out["logit_ge_scaled"].count() == 40
    missing = {(r["iso3c"], r["country"]) for r in out["missing_income"].collect()}
    assert missing == {("N11", "NATION_11")}
    grid = out["map_counts"]
    whole = grid.filter(F.col("design") == "All designs").agg(F.sum("n_studies")).first()[0]
    assert whole == study.filter("lat is not null and long is not null and continent is not null").count()
    most = out["places_over_time"].agg(F.max("cum_countries")).first()[0]
    assert out["most_places"].first()["max_cum_countries"] == most
    squares = out["residual_matrix"].agg(F.sum(F.pow("pearson_residual", F.lit(2.0)))).first()[0]
    assert out["test"].first()["statistic"] == pytest.approx(squares)


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0] if "== Initial Plan ==" in text else text


def scans(text, table):
    return len(re.findall(rf"FileScan [^\n]*{table}\.parquet", text))


def orders(spark):
    return V.table(spark, SF, "orders")


def test_cumulative_share_scans_once(spark):
    rows = orders(spark).withColumn("year", F.year("o_orderdate"))
    levels = [p for p, _ in V.SECOND_LABELS]
    df = cumulative.cumulative_share(rows, "o_orderpriority", "year", levels)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert scans(final, "orders") == 1
    assert "ReusedExchange" in text


def test_shares_scan_once_and_read_only_their_columns(spark):
    df = share.share_of_distinct(orders(spark), "o_orderstatus", "o_custkey", ["F", "O", "P"])
    text = final_plan(df)
    assert scans(text, "orders") == 1
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in text


def test_year_range_is_pushed_down(spark):
    df = orders(spark).filter(F.col("o_totalprice").between(100, 200))
    assert "GreaterThanOrEqual(o_totalprice,100.0)" in final_plan(df)


@pytest.mark.parametrize(
    "name", ["cumulative_share", "grid_counts", "share_overall", "pearson_residuals", "chi_squared", "composition_by_synopsis", "median_interval", "epred_draws", "group_order", "covariate_grid"]
)
def test_no_cartesian_product_and_no_global_window(spark, name):
    text = C.all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    windows = re.findall(r"Window \[[^\n]*", text)
    assert not any("windowspecdefinition(specifiedwindowframe" in w for w in windows)


def test_quantiles_of_one_hot_group_are_not_gathered(spark):
    """Spark's own percentile, which buffers a group, is not in the plan."""
    df = materialise(spark.range(200_000).select(F.lit("hot").alias("k"), F.rand(5).alias("x")))
    got = quantiles.group_quantiles(df, ["k"], "x", {"m": 0.5})
    text = final_plan(got)
    assert "percentile(" not in text
    exact = df.agg(F.percentile("x", 0.5)).first()[0]
    assert got.first()["m"] == pytest.approx(exact, abs=1e-12)


def test_bootstrap_output_is_bounded_by_draws_and_cells(spark):
    rows = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("study"),
        (F.col("id") % 4).alias("cell"),
    )
    out = bootstrap.bootstrap_cells(rows, "study", ["cell"], 10)
    assert out.count() <= 40
    hot = rows.filter("study = 0").count()
    assert hot > 16_000


def test_levels_outside_the_list_fail_loudly(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z")], "id int, c string")
    with pytest.raises(Exception, match="outside the given levels"):
        share.share_of_distinct(df, "c", "id", ["a"]).collect()


def test_vocabulary():
    assert len(S.DESIGN_RECODE_MAIN) == 10 and len(S.DESIGN_RECODE_SECOND) == 5
    assert len(S.LABEL_RULES) == 11
