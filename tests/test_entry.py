"""Every query with SQL against DuckDB; the others run and return rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# At the smallest scale a draw can leave a (subfield, design) cell empty, and an
# unpenalised log ratio is then infinite.
LARGER = "/root/testdata/sf0.01"
NEEDS_FULL_CELLS = {
    "multinomial_draws_saturated",
    "coefficient_summary_saturated",
    "elpd_compare_saturated",
    "epred_draws_saturated",
}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, name):
    d = LARGER if name in NEEDS_FULL_CELLS else SF
    got = entry.queries()[name](spark, d)
    assert check.compare(got, check.duck(d), entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
