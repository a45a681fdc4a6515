from pyspark.sql import functions as F

from tallymix import schema as S
from tallymix.operators import prep, quality, share


def test_bad_numbers_become_null(spark, rows):
    df = spark.createDataFrame([("abc",), ("NA",), ("1987",), (None,)], "y string")
    out = prep.coerce_numeric(df, {"year": ("y", "int")})
    assert rows(out, "year") == [(None,), (None,), (None,), (1987,)]


def test_recode_passes_unlisted_through_and_domain_drops_them(spark, rows):
    df = spark.createDataFrame([("Paired RCT",), ("Review",), (None,)], "d string")
    out = prep.recode_category(df, "d", S.DESIGN_RECODE_MAIN)
    assert rows(out) == [(None,), ("Rand.exp.",), ("Review",)]
    ranked = prep.ordered_domain(out, "d", S.DESIGN_LEVELS, "rank")
    assert rows(ranked) == [(None, None), (None, None), ("Rand.exp.", 5)]


def test_recodes_cover_exactly_the_levels():
    assert set(S.DESIGN_RECODE_MAIN.values()) == set(S.DESIGN_LEVELS)
    assert set(S.DESIGN_RECODE_SECOND.values()) == set(S.DESIGN_LEVELS)


def test_levels_present_are_ranked_among_themselves(spark, rows):
    df = spark.createDataFrame([("c",), ("a",), ("a",), (None,)], "x string")
    assert rows(prep.levels_present(df, "x", ["a", "b", "c"])) == [("a", 1), ("c", 2)]


def test_relevel_moves_one_level_last(spark, rows):
    df = spark.createDataFrame([(x,) for x in S.DESIGN_LEVELS], "d string")
    out = {r[0]: r[1] for r in prep.relevel(df, "d", S.DESIGN_LEVELS, "BACI").collect()}
    assert out == {"After": 1, "BA": 2, "CI": 3, "Rand.exp.": 4, "BACI": 5}


def test_union_is_by_name(spark, rows):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, id int")
    assert rows(prep.append_by_name(a, b)) == [(1, "x"), (2, "y")]


def test_inequality_drops_null(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert rows(prep.filter_equal(df, "x", "a", negate=True)) == [("b",)]
    assert rows(prep.filter_equal(df, "x", "a")) == [("a",)]


def test_labels(spark):
    df = spark.createDataFrame(
        [
            ("Management of X and Y Conservation in Z",),
            ("Sustainable Aquaculture",),
            ("Biodiversity of Marine Artificial Structures",),
            ("Non-English language",),
            ("Control of Freshwater Invasive Species",),
            ("Mediterranean Farmland",),
            ("Terrestrial Invertebrate Conservation",),
        ],
        "s string",
    )
    out = [r[0] for r in prep.shorten_labels(df, "s", S.LABEL_RULES).collect()]
    assert out == [
        "X & Y",
        "Sust.Aquaculture",
        "Marine Art. Structures",
        "NE-language",
        "Control of FW Inv.Sp.",
        "Med. Farmland",
        "Terrestrial Invert.",
    ]


def test_distinct_counts_null_once(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert rows(quality.distinct_counts(df, ["x"])) == [(2,)]
    none = df.filter(F.lit(False))
    assert rows(quality.distinct_counts(none, ["x"])) == [(0,)]


def test_coverage_filter_treats_null_group_as_a_group(spark, rows):
    df = spark.createDataFrame(
        [("g", "a"), ("g", "b"), ("h", "a"), (None, "a"), (None, "b")], "g string, c string"
    )
    assert rows(quality.coverage_filter(df, "g", "c", 2)) == [
        (None, "a"), (None, "b"), ("g", "a"), ("g", "b"),
    ]
    thin = df.filter(~(F.col("g").isNull() & (F.col("c") == "b")))
    assert rows(quality.coverage_filter(thin, "g", "c", 2)) == [("g", "a"), ("g", "b")]


def test_coverage_filter_keeps_entities_of_kept_groups(spark):
    df = spark.range(2000).select(
        (F.col("id") % 7).alias("g"), (F.col("id") % 5).alias("c"), F.col("id")
    )
    df = df.filter((F.col("g") != 3) | (F.col("c") < 4))
    out = quality.coverage_filter(df, "g", "c", 5)
    assert out.select("g").distinct().count() == 6
    assert out.count() == df.filter("g <> 3").count()


def test_drop_listed_keeps_null_that_is_not_listed(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    keys = spark.createDataFrame([("a",)], "k string")
    assert rows(quality.drop_listed(df, keys, ["k"])) == [(None,), ("b",)]


def test_consistent_multi_group(spark, rows):
    df = spark.createDataFrame(
        [(1, "s", "a"), (1, "t", "a"), (2, "s", "a"), (2, "t", "b"), (3, "s", "a")],
        "id int, g string, c string",
    )
    assert rows(quality.consistent_multi_group(df, "id", "g", "c")) == [(1, 2, 1)]


def test_multi_category_counts_null_as_a_category(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "id int, c string")
    assert rows(quality.multi_category_ids(df, "id", "c")) == [(1, 2)]


def test_key_difference_is_distinct_and_null_safe(spark, rows):
    a = spark.createDataFrame([("x",), ("x",), (None,), ("z",)], "k string")
    b = spark.createDataFrame([("z",), (None,)], "k string")
    assert rows(quality.key_difference(a, b, "k")) == [("x",)]
    assert rows(quality.key_difference(a, b.filter("k is not null"), "k")) == [(None,), ("x",)]


def test_shares_of_distinct_agree_with_and_without_levels(spark, rows):
    df = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "b"), (3, None)], "id int, c string"
    )
    want = [(None, 1, 0.25), ("a", 2, 0.5), ("b", 2, 0.5)]
    assert rows(share.share_of_distinct(df, "c", "id", ["a", "b", "unseen"])) == want
    assert rows(share.share_of_distinct(df, "c", "id")) == want


def test_composition_within_parent_and_overall(spark, rows):
    df = spark.createDataFrame(
        [("p", "a"), ("p", "a"), ("p", "b"), (None, "a")], "p string, c string"
    )
    out = share.composition(df, "c", ["p"], scale=100)
    assert [(p, c, n, round(s, 6)) for p, c, n, s in rows(out)] == [
        (None, "a", 1, 100.0), ("p", "a", 2, 66.666667), ("p", "b", 1, 33.333333),
    ]
    assert rows(share.composition(df, "c")) == [("a", 3, 0.75), ("b", 1, 0.25)]


def test_group_order_positions(spark, rows):
    df = spark.createDataFrame(
        [(f"g{i:03d}", "a", ((i * 37) % 100) / 100.0) for i in range(100)], "g string, c string, share double"
    )
    got = share.group_order(df, "g", "c", "a").collect()
    want = sorted(got, key=lambda r: (-r["share"], r["g"]))
    assert [r["position"] for r in want] == list(range(1, 101))


def test_closed_levels_name_their_column_once(spark):
    """Nested recodings must not double with every step: what is generated from them stays small."""
    df = spark.createDataFrame([("A",), ("z",), (None,)], "held string")
    out = prep.ordered_domain(df, "held", ["A", "B"]).withColumnRenamed("held", "c")
    assert sorted(map(str, (r[0] for r in out.collect()))) == ["A", "None", "None"]
    step = prep.ordered_domain(df, "held", ["A", "B"])._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert step.split(" AS ")[0].count("held#") == 1
