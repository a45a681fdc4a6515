import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymix.operators import binning, cumulative, quantiles, reshape, share


def years(spark, values):
    return spark.createDataFrame([(y,) for y in values], "year int")


EDGES = [1979, 1980, 1989, 1990, 2019, 2020, 2021, None]


def test_decades_drop_the_end(spark, rows):
    out = binning.bin_steps(years(spark, EDGES), "year", 1980, 2020, 10, "b")
    assert rows(out) == [(1980, 1980), (1989, 1980), (1990, 1990), (2019, 2010)]


def test_five_years_close_the_last_bin(spark, rows):
    out = binning.bin_steps(
        years(spark, EDGES), "year", 1980, 2020, 5, "b", close_last=True, suffix="-"
    )
    assert rows(out) == [
        (1980, "1980-"), (1989, "1985-"), (1990, "1990-"), (2019, "2015-"), (2020, "2015-"),
    ]


def test_grid_halves_go_to_even(spark):
    df = spark.createDataFrame([(9.0,), (15.0,), (3.0,), (-3.0,), (None,)], "lat double")
    out = [r[0] for r in binning.bin_grid(df, [("lat", "b")], 6).select("b").collect()]
    assert out == [12.0, 12.0, 0.0, 0.0, None]
    assert math.copysign(1, out[3]) == 1


def test_grid_counts_two_grains(spark, rows):
    df = spark.createDataFrame(
        [(0.0, "a", 1), (0.0, "a", 1), (0.0, "b", 1), (6.0, None, 2), (6.0, None, None)],
        "cell double, d string, id int",
    )
    assert rows(binning.grid_counts(df, ["cell"], "d", "All")) == [
        (0.0, "All", 3), (0.0, "a", 2), (0.0, "b", 1), (6.0, None, 2), (6.0, "All", 2),
    ]
    assert rows(binning.grid_counts(df, ["cell"], "d", "All", distinct_id="id")) == [
        (0.0, "All", 1), (0.0, "a", 1), (0.0, "b", 1), (6.0, None, 2), (6.0, "All", 2),
    ]


def test_quantile_bins_share_ties_and_close_right(spark, rows):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 4, 4, 5, 9]] + [(None,)], "x double")
    out = dict(rows(binning.bin_quantile(df, "x", 2, "b").distinct()))
    assert out == {None: None, 1.0: 1, 2.0: 1, 3.0: 1, 4.0: 1, 5.0: 2, 9.0: 2}


def test_repeated_breaks_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "x double")
    with pytest.raises(Exception, match="too few distinct values"):
        binning.bin_quantile(df, "x", 4, "b").collect()


PROBS = {"lo": 0.025, "mid": 0.5, "hi": 0.975}


@pytest.mark.parametrize("fn", [quantiles.group_quantiles, quantiles.bounded_quantiles])
def test_quantiles_interpolate(spark, fn):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0, None)], "x double")
    got = fn(df, [], "x", PROBS).first()
    assert [round(v, 9) for v in got] == [1.075, 2.5, 9.475]


def test_group_quantiles_equal_percentile_on_large_skewed_groups(spark, rows):
    """Several passes (few buckets), a hot group, heavy ties, a NULL key, small groups."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 3 == 1, F.lit(None))
        .when(F.col("id") < 30, F.lit("tiny"))
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string")))
        .alias("k"),
        F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.rand(3) * 20).alias("x"),
    ).cache()
    probs = {"a": 0.0, "b": 0.025, "c": 0.3, "d": 0.5, "e": 0.975, "f": 1.0}
    got = rows(quantiles.group_quantiles(df, ["k"], "x", probs, bits=4))
    want = rows(quantiles.bounded_quantiles(df, ["k"], "x", probs))
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g[1:] == pytest.approx(w[1:], abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 18, 250, 401])
def test_group_quantiles_around_the_size_of_a_pass(spark, n):
    df = spark.range(n).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    probs = {f"q{i}": i / 10 for i in range(11)}
    got = tuple(quantiles.group_quantiles(df, [], "x", probs, bits=4).first())
    want = tuple(quantiles.bounded_quantiles(df, [], "x", probs).first())
    assert got == pytest.approx(want)


def test_sort_keys_order_like_their_doubles(spark):
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308]
    odd += [float("inf"), float("-inf")] + [s * 2.0**e * (1 + d) for e in range(-1022, 1024, 31) for d in (0.0, 2.0**-52, -(2.0**-53)) for s in (1, -1)]
    x = np.concatenate([bits.view(np.float64), odd, rng.normal(size=500)])
    x = x[~np.isnan(x)]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", quantiles.sort_key(F.col("x")).alias("k"))
    got = np.array([(r["x"], r["k"]) for r in df.collect()], dtype=object)
    v, k = got[:, 0].astype(float), got[:, 1].astype(np.int64)
    bits = np.abs(v).view(np.int64)
    assert (k == np.where(v < 0, -bits, bits)).all()


@pytest.mark.parametrize("bits", [3, 12])
def test_quantiles_of_odd_values(spark, rows, bits):
    values = {
        "none": [None, None],
        "some": [None, 1.0, 4.0],
        "wide": [1e300, -1e300, 5e-324, 0.0, -0.0, 3.0] * 9,
        "ends": [float("inf"), float("-inf"), 2.0],
        "nans": [float("nan"), 1.0, 2.0],
        "ties": [5.0] * 300 + [6.0],
        None: [1.0, 2.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, x double")
    got = {r["k"]: tuple(r)[1:] for r in quantiles.group_quantiles(df, ["k"], "x", {"a": 0.0, "m": 0.5, "z": 1.0}, bits).collect()}
    assert got["none"] == (None, None, None) and got["some"] == (1.0, 2.5, 4.0) and got[None] == (1.0, 1.5, 2.0)
    assert got["wide"] == (-1e300, 0.0, 1e300) and got["ends"] == (float("-inf"), 2.0, float("inf"))
    assert got["nans"][:2] == (1.0, 2.0) and math.isnan(got["nans"][2]) and got["ties"] == (5.0, 5.0, 6.0)
    nothing = df.filter("false")
    assert quantiles.group_quantiles(nothing, ["k"], "x", {"m": 0.5}, bits).count() == 0
    assert [tuple(r) for r in quantiles.group_quantiles(nothing, [], "x", {"m": 0.5}, bits).collect()] == [(None,)]


def test_what_a_rank_keeps_does_not_grow(spark, monkeypatch):
    """Rows of the tables written between passes, from 2e5 to 2e6 values in one group."""
    kept, stored = [], quantiles.written_with

    def counted(df, name, **measures):
        out, seen = stored(df, name, **measures)
        kept.append(out.count())
        return out, seen

    monkeypatch.setattr(quantiles, "written_with", counted)
    most = []
    for n in (200_000, 2_000_000):
        kept.clear()
        df = spark.range(n).select(F.rand(5).alias("x"))
        got = quantiles.group_quantiles(df, [], "x", {"a": 0.1, "m": 0.5}).first()
        assert got["m"] == pytest.approx(0.5, abs=0.01)
        most.append((max(kept), len(kept)))
    assert most[0][0] == most[1][0] == 4 and most[1][1] <= 4


def test_unpivot_keeps_null_cells(spark, rows):
    df = spark.createDataFrame([("a", 1.0, None)], "code string, X1960 double, X1961 double")
    out = reshape.lengthen_years(df, ["code"], ["X1960", "X1961"], "v", "X")
    assert rows(out) == [("a", 1960, 1.0), ("a", 1961, None)]


def test_empirical_logit_absent_cell_is_one(spark):
    counts = spark.createDataFrame(
        [("x", "After", 4), ("x", "BA", 8), ("y", "BA", 3)], "b string, d string, n long"
    )
    got = {
        (r["b"], r["comparison"]): r["logit_value"]
        for r in reshape.empirical_logit(counts, "b", "d", ["After", "BA", "CI"], "After").collect()
    }
    assert got == {
        ("x", "BA vs. After"): pytest.approx(math.log(2)),
        ("x", "CI vs. After"): pytest.approx(math.log(1 / 4)),
        ("y", "BA vs. After"): pytest.approx(math.log(3)),
        ("y", "CI vs. After"): pytest.approx(0.0),
    }


def test_pivot_fill_leaves_present_cells(spark, rows):
    counts = spark.createDataFrame([("x", "a", 5)], "k string, d string, n long")
    assert rows(reshape.widen(counts, "k", "d", ["a", "b"], fill=1)) == [("x", 5, 1)]


def test_complete_grid_uses_all_levels_and_null_if_present(spark, rows):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (3, None)], "year int, d string"
    )
    counts = share.count_by(df, ["year", "d"])
    assert rows(cumulative.complete_grid(counts, "year", "d", ["a", "b"])) == [
        (1, None, 0), (1, "a", 2), (1, "b", 0), (3, None, 1), (3, "a", 0), (3, "b", 0),
    ]


def test_cumulative_share_puts_null_year_last(spark, rows):
    df = spark.createDataFrame([(2, "a"), (1, "b"), (None, "a")], "year int, d string")
    out = cumulative.cumulative_share(df, "d", "year", ["a", "b"])
    assert [(y, d, c, t) for y, d, _, c, t, _ in rows(out)] == [
        (None, "a", 2, 3), (None, "b", 1, 3), (1, "a", 0, 1), (1, "b", 1, 1), (2, "a", 1, 2), (2, "b", 1, 2),
    ]


def test_cumulative_distinct_against_brute_force(spark, rows):
    """Gap years, a NULL country, a NULL design, a NULL year, a late start."""
    data = [
        (2000, "a", "X", "P"), (2000, "a", None, "P"), (2002, "a", "X", "Q"), (2002, "a", None, "P"),
        (2001, "b", "Y", "P"), (2003, "b", "X", "Q"), (1999, None, "Z", "P"), (None, "b", "W", "P"),
    ]
    df = spark.createDataFrame(data, "year int, d string, country string, continent string")
    steps = sorted({y for y, *_ in data if y is not None})
    want = []
    for d in ("a", "b"):
        countries, continents = set(), set()
        for s in steps:
            new = [r for r in data if r[1] == d and r[0] == s]
            countries |= {r[2] for r in new}
            continents |= {r[3] for r in new}
            if countries:
                want.append((d, s, len(countries), len(continents)))
    out = cumulative.cumulative_distinct(
        df, "d", "year", {"n_country": "country", "n_continent": "continent"}
    )
    assert rows(out) == sorted(want)
    final = cumulative.cumulative_max(out, ["n_country", "n_continent"])
    assert rows(final) == [(2, 2)]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_distinct_counts_of_many_steps(spark, parts):
    """Thousands of steps in several ranges, against sets that grow row by row."""
    rng = np.random.default_rng(6)
    rows = [(str(rng.choice(list("abc"))), int(t), None if rng.random() < 0.05 else int(rng.integers(0, 400))) for t in rng.integers(0, 3000, 4000)]
    rows += [(None, 5, 1), ("a", None, 2), ("late", 2999, 3)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "c string, t int, v int")
        got = {(r["c"], r["t"]): r["n"] for r in cumulative.cumulative_distinct(df, "c", "t", {"n": "v"}).collect()}
        assert cumulative.cumulative_distinct(df.filter("false"), "c", "t", {"n": "v"}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    steps, want = sorted({t for c, t, _ in rows if t is not None}), {}
    for c in ("a", "b", "c", "late"):
        seen = set()
        for t in steps:
            seen |= {v for x, y, v in rows if x == c and y == t}
            if seen:
                want[c, t] = len(seen)
    assert got == want
