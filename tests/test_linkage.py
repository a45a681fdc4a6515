import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymix.functions import sizing
from tallymix.operators import association, intervals, linkage, quality


def test_null_keys_match_and_duplicates_fan_out(spark, rows):
    facts = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    dim = spark.createDataFrame([("a", 10), ("a", 11), (None, 12)], "k string, w int")
    got = {tuple(r) for r in linkage.attach(facts, dim, ["k"]).select("k", "v", "w").collect()}
    assert got == {("a", 1, 10), ("a", 1, 11), ("z", 3, None), (None, 2, 12)}


def test_unique_dimension_keeps_row_count(spark):
    facts = spark.range(1000).select((F.col("id") % 13).alias("k"))
    dim = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    out = linkage.attach(facts, dim, ["k"])
    assert out.count() == 1000
    assert out.filter("w is null").select("k").distinct().count() == 3


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_skewed_key_joins_the_same_with_and_without_broadcast(spark, threshold):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        facts = spark.range(3000).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("k")
        )
        dim = spark.createDataFrame([("hot", 1), ("0", 2)], "k string, w int")
        out = sizing.null_safe_join(facts, dim, ["k"], "left")
        assert out.count() == 3000
        assert out.filter("w = 1").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_names_by_priority_then_override(spark, rows):
    df = spark.createDataFrame(
        [("United Kingdom",), ("UK",), ("Czech Republic",), ("Atlantis",), ("NA",), (None,), ("UK",)],
        "country string",
    )
    cross = spark.createDataFrame(
        [("(?i)united.?kingdom", "GBR", 2), ("(?i)^united", "XXX", 3), ("^UK$", "GBR", 1)],
        "pattern string, iso3c string, priority int",
    )
    out = linkage.standardise_names(df, "country", cross, {"Czech Republic": "CZE", "NA": None})
    assert sorted(map(str, rows(out))) == sorted(
        map(
            str,
            [
                ("United Kingdom", "GBR"), ("UK", "GBR"), ("UK", "GBR"), ("Czech Republic", "CZE"),
                ("Atlantis", None), ("NA", None), (None, None),
            ],
        )
    )


def test_unmatched_keys(spark, rows):
    facts = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), (None, 1)], "k string, y int")
    dim = spark.createDataFrame([("a", 1), (None, 1)], "k string, y int")
    assert rows(quality.unmatched(facts, dim, ["k", "y"], ["k"])) == [("b",)]


def test_derived_indicator_needs_both(spark, rows):
    df = spark.createDataFrame([(2.0, 50.0), (None, 1.0), (1.0, None)], "p double, a double")
    assert rows(linkage.derived_indicator(df, "p", "a", "v"), "v") == [(1.0,)]


def test_standardise_uses_sample_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    out = linkage.standardise(df, ["x", "c"]).collect()
    assert sorted(r["x_scaled"] for r in out) == [-1.0, 0.0, 1.0]
    assert [r["c_scaled"] for r in out] == [None, None, None]


def cells(spark, counts):
    data = [(a, b) for (a, b), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(data, "a string, b string")


def chi2(counts, yates=False):
    ra, cb = {}, {}
    for (a, b), n in counts.items():
        ra[a] = ra.get(a, 0) + n
        cb[b] = cb.get(b, 0) + n
    total = sum(counts.values())
    grid = [(counts.get((a, b), 0), ra[a] * cb[b] / total) for a in ra for b in cb]
    y = min([0.5] + [abs(o - e) for o, e in grid]) if yates else 0.0
    return sum((abs(o - e) - y) ** 2 / e for o, e in grid), (len(ra) - 1) * (len(cb) - 1)


def test_chi_squared_counts_the_zero_cell(spark):
    counts = {("p", "x"): 5, ("p", "y"): 7, ("q", "x"): 9, ("r", "x"): 3, ("r", "y"): 4}
    got = association.chi_squared(cells(spark, counts), "a", "b").first()
    want, df = chi2(counts)
    assert got["statistic"] == pytest.approx(want)
    assert got["df"] == df == 2
    assert got["p_value"] == pytest.approx(math.exp(-want / 2))


def test_residuals_skip_the_zero_cell_but_the_matrix_has_it(spark):
    counts = {("p", "x"): 5, ("p", "y"): 7, ("q", "x"): 9, ("r", "x"): 3, ("r", "y"): 4}
    df = cells(spark, counts)
    rows_ = association.pearson_residuals(df, "a", "b").collect()
    matrix = association.residual_matrix(df, "a", "b").collect()
    assert len(rows_) == 5 and len(matrix) == 6
    by_hand = {(r["a"], r["b"]): r["pearson_residual"] for r in rows_}
    full = {(r["a"], r["b"]): r["pearson_residual"] for r in matrix}
    for k, v in by_hand.items():
        assert v == pytest.approx(full[k])
    assert sum(v * v for v in full.values()) == pytest.approx(chi2(counts)[0])


def test_two_by_two_has_the_correction(spark):
    counts = {("p", "x"): 12, ("p", "y"): 5, ("q", "x"): 6, ("q", "y"): 9}
    got = association.chi_squared(cells(spark, counts), "a", "b").first()
    want, _ = chi2(counts, yates=True)
    assert got["statistic"] == pytest.approx(want)
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(want / 2)))


@pytest.mark.parametrize(
    "x, df, p", [(3.841458820694124, 1, 0.05), (11.07049769351635, 5, 0.05), (9.487729036781154, 4, 0.05), (0.0, 3, 1.0)]
)
def test_upper_tail(spark, x, df, p):
    out = spark.createDataFrame([(x, df)], "x double, k int")
    assert out.select(association.chi2_upper_tail("x", "k")).first()[0] == pytest.approx(p, abs=1e-9)


def test_contingency_keeps_zero_drops_missing(spark, rows):
    df = spark.createDataFrame(
        [("p", "x"), ("p", "x"), ("q", None), (None, "x"), ("r", "y")], "a string, b string"
    )
    assert rows(association.contingency(df, "a", "b", ["x", "y"])) == [("p", 2, 0), ("r", 0, 1)]


def test_group_against_grand_mean(spark):
    draws = spark.range(200).select(F.col("id").cast("int").alias("draw"), (F.rand(1) * 0.01).alias("e"))
    parts = [
        draws.select("draw", F.lit(g).alias("g"), F.lit("c").alias("c"), (F.col("e") + v).alias("p"))
        for g, v in (("high", 0.5), ("low", 0.1), ("mid", 0.3))
    ]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for bounded in (True, False):
        out = intervals.group_vs_grand_mean(df, "g", "draw", "c", "p", bounded=bounded).collect()
        assert {r["g"]: r["direction"] for r in out} == {
            "high": "Higher than average", "low": "Lower than average", "mid": "Not significant",
        }
        assert {r["g"]: r["is_significant"] for r in out} == {"high": True, "low": True, "mid": False}


@pytest.mark.parametrize("block", [1, 10_000])
def test_the_full_grid_is_bounded(spark, monkeypatch, block):
    monkeypatch.setattr(association, "GRID_BLOCK", block)
    df = cells(spark, {("p", "x"): 5, ("p", "y"): 7, ("q", "x"): 9, ("r", "z"): 3})
    assert association.residual_matrix(df, "a", "b").count() == 9
    assert association.residual_matrix(df.filter("false"), "a", "b").count() == 0
    with pytest.raises(ValueError, match="more than 8 cells"):
        association.residual_matrix(df, "a", "b", most=8)


def test_required_literals():
    of = linkage.required_literals
    has = lambda p: [{r for r in runs if r} for runs in of(p)]
    assert has("(?i)^united.?kingdom$") == [{"united", "kingdom"}]
    assert has("ab|cd(e|f)gh") == [{"ab"}, {"cd", "gh"}]
    assert has("colou?rs*x+y{0,2}z") == [{"colo", "r", "x", "z"}]
    assert has("a[bc]d\\.e\\w") == [{"a", "d", "e"}]
    assert of("(?<!x)abc") is None and of("(abc") is None and of("\\Qa\\E") is None and of("[a") is None


def test_matches_are_those_of_trying_every_pattern(spark):
    rng = np.random.default_rng(3)
    syllables = ["land", "Ko", "re", "stan", "GUI", "nea", " of ", "is", "St.", "é", "-", "an"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    names = sorted({word() for _ in range(250)} | {"", "UK", "UK\n", "ab", "United Kingdom"})
    marks = ["^{}$", "(?i){}", "{}", "^{}", "{}.*x?", "(?i)^(the )?{}$", "{}|zzz", "[Kk]o.{{0,3}}{}", "\\b{}", "{}+", "(?!x){}"]
    patterns = [(rng.choice(marks).format(word().replace(".", "\\.")), f"c{i}", int(rng.integers(0, 9))) for i in range(120)]
    patterns += [("^UK$", "GBR", 0), ("^..$", "TWO", 5), ("(?i)KINGDOM", "GBR", 1)]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "country string")
    cross = spark.createDataFrame(patterns, "pattern string, iso3c string, priority int")
    got = {r["country"]: r["iso3c"] for r in linkage.match_names(df, "country", cross, {"ab": "OVR", "": "OVR"}, "iso3c").collect()}
    pairs = df.crossJoin(cross).filter(F.rlike("country", F.col("pattern")))
    best = pairs.groupBy("country").agg(F.min(F.struct("priority", "iso3c", "pattern"))["iso3c"].alias("iso3c"))
    want = {r["country"]: r["iso3c"] for r in best.collect()}
    over = {"ab": "OVR", "": "OVR"}
    assert got == {n: want.get(n, over.get(n)) for n in [*names, None]}
    assert len(set(want)) > 100


def test_too_many_loose_patterns_raise(spark, monkeypatch):
    monkeypatch.setattr(linkage, "MAX_LOOSE", 1)
    df = spark.createDataFrame([("x",)], "country string")
    cross = spark.createDataFrame([(".x", "A", 1), ("y.", "B", 2)], "pattern string, iso3c string, priority int")
    with pytest.raises(ValueError, match="2 patterns have no 3 letters"):
        linkage.match_names(df, "country", cross, {}, "iso3c")
