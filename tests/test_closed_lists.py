"""One rule for values outside a closed list, and NULL keys that match each other."""

import pytest

from tallymix.operators import association, cumulative, intervals, reshape, share


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: cumulative.complete_grid(df, "step", "kind", ["a", "b"]),
        lambda df: reshape.widen(df, "step", "kind", ["a", "b"]),
        lambda df: association.contingency(df, "step", "kind", ["a", "b"]),
        lambda df: share.share_of_distinct(df, "kind", "step", ["a", "b"]),
        lambda df: share.share_of_distinct(df, "kind", "step", ["a", *map(str, range(62))]),
    ],
)
def test_a_value_outside_the_levels_raises(spark, operator):
    df = spark.createDataFrame([(1, "a", 1), (1, "z", 1), (2, "a", 1)], "step int, kind string, n bigint")
    with pytest.raises(Exception, match="outside the given levels: z"):
        operator(df).collect()
    operator(df.filter("kind = 'a'")).collect()


def test_a_null_category_meets_its_grand_mean(spark):
    rows = [(d, g, None, v + d / 100) for d in range(5) for g, v in (("x", 0.1), ("y", 0.9))]
    df = spark.createDataFrame(rows, "draw int, grp string, kind string, epred double")
    got = intervals.group_vs_grand_mean(df, "grp", "draw", "kind").collect()
    assert all(r["is_significant"] is True and r["kind"] is None for r in got)
