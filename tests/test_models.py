import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymix.models import bootstrap, compare, estimator, fit, predict, splines
from tallymix.models.design import Design, to_cells
from tallymix.sources import tables

from reference_fit import fit_frame, newton

LEVELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    """Rows with a known drift of the mix over x; several rows per study."""
    u = F.rand(11)
    df = spark.range(6000).select(
        (F.col("id") % 400).alias("study"),
        ((F.col("id") % 7) + 2000).cast("int").alias("year"),
        F.when(F.col("id") % 3 == 0, F.lit("g1")).when(F.col("id") % 3 == 1, F.lit("g2")).otherwise("g3").alias("g"),
        u.alias("u"),
    )
    cut = 0.2 + 0.06 * (F.col("year") - 2000)
    df = df.withColumn("d", F.when(F.col("u") < cut, "a").when(F.col("u") < cut + 0.2, "b").otherwise("c"))
    return df.drop("u").cache()


FULL = Design("d", LEVELS, ["year"], {"g": ["g1", "g2", "g3"]})
SATURATED = Design("d", LEVELS, [], {"g": ["g1", "g2", "g3"]})


def as_matrix(rows, design):
    got = {(r["category"], r["term"]): r["estimate"] for r in rows}
    return np.array([[got[(k, t)] for t in design.terms] for k in design.levels[1:]])


def test_saturated_fit_gives_observed_shares(spark, data):
    cells = to_cells(data, SATURATED)
    coef = fit.multinomial_fit(cells, SATURATED, prior_sd=None).collect()
    beta = np.vstack([np.zeros((1, 3)), as_matrix(coef, SATURATED)])
    counts = {(r["g"], r["d"]): r["n"] for r in cells.collect()}
    for i, g in enumerate(["g1", "g2", "g3"]):
        x = np.array([1.0, g == "g2", g == "g3"])
        p = np.exp(beta @ x)
        p /= p.sum()
        total = sum(counts[(g, d)] for d in LEVELS)
        for k, d in enumerate(LEVELS):
            assert p[k] == pytest.approx(counts[(g, d)] / total, abs=1e-4)


def test_both_fits_agree_under_the_same_penalty(spark, data):
    cells = to_cells(data, FULL)
    far = as_matrix(fit.multinomial_fit(cells, FULL).collect(), FULL)
    pdf = cells.toPandas()
    near = fit_frame(pdf, FULL, "n", fit.PRIOR_SD)
    near = as_matrix(near.to_dict("records"), FULL)
    assert near[:, 1:] == pytest.approx(far[:, 1:], abs=1e-3)
    assert near[:, 0] == pytest.approx(far[:, 0], abs=2.0)  # intercept at year 0
    at = np.array([1.0, 2003.0, 0.0, 0.0])
    assert near @ at == pytest.approx(far @ at, abs=1e-3)


def test_newton_solves_the_penalised_score(data):
    pdf = to_cells(data, FULL).toPandas()
    pdf["year"] -= 2003
    x = FULL.matrix(pdf)
    y = pdf["d"].map({v: i for i, v in enumerate(LEVELS)}).to_numpy()
    w = pdf["n"].to_numpy(dtype=float)
    beta = newton(x, y, w, 3, 2.5)
    eta = x @ beta.T
    p = np.exp(eta - eta.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    t = np.zeros_like(p)
    t[np.arange(len(y)), y] = w
    grad = (t - w[:, None] * p).T @ x
    # On the symmetric scale the slopes average to zero and equal 2.5^2 x the score.
    slopes = beta[:, 1:] - beta[:, 1:].mean(axis=0)
    assert grad[:, 1:] == pytest.approx(slopes / 2.5**2, abs=1e-6)
    assert grad[:, 0] == pytest.approx(np.zeros(3), abs=1e-6)


def test_all_rows_of_a_study_move_together(spark, data, rows):
    draws = 20
    out = bootstrap.bootstrap_cells(data, "study", ["study", "d"], draws)
    joined = out.join(data.groupBy("study", "d").agg(F.count("*").alias("c")), ["study", "d"])
    ratio = joined.withColumn("w", F.col("n") / F.col("c")).groupBy("draw", "study").agg(
        F.count_distinct("w").alias("k"), F.max("w").alias("w")
    )
    assert ratio.filter("k > 1").count() == 0
    mean = ratio.agg(F.sum("w") / (400 * draws)).first()[0]
    assert mean == pytest.approx(1.0, abs=0.05)


def test_poisson_edges():
    edges = bootstrap.poisson_edges()
    assert edges[0] == int(math.exp(-1) * 2**32)
    assert edges == sorted(edges) and edges[-1] < 2**32


def test_unit_weights_give_the_point_fit(spark, data):
    cells = to_cells(data, FULL).withColumn("draw", F.lit(1))
    one = fit.fit_groups(cells, "draw", 1, FULL).collect()
    point = fit_frame(to_cells(data, FULL).toPandas(), FULL, "n", fit.PRIOR_SD)
    assert as_matrix(one, FULL) == pytest.approx(as_matrix(point.to_dict("records"), FULL), rel=1e-6)


def test_one_estimator_at_every_size(spark, data):
    """No gap on the intercept at year 0 either, whatever the size of a draw."""
    cells = to_cells(data, FULL).withColumn("draw", F.explode(F.array(F.lit(1), F.lit(2))))
    cells = cells.withColumn("n", F.col("n") * F.col("draw"))
    near = fit.fit_groups(cells, "draw", 2, FULL).collect()
    far = fit.fit_groups(cells, "draw", 2, FULL).collect()
    for draw in (1, 2):
        pdf = cells.filter(F.col("draw") == draw).toPandas()
        want = as_matrix(fit_frame(pdf, FULL, "n", fit.PRIOR_SD).to_dict("records"), FULL)
        for got in (near, far):
            assert as_matrix([r for r in got if r["draw"] == draw], FULL) == pytest.approx(want, rel=1e-6, abs=1e-8)


def test_a_fit_that_has_not_converged_raises(spark, data):
    cells = to_cells(data, FULL).withColumn("draw", F.lit(1))
    with pytest.raises(ValueError, match="draw \\[1\\]"):
        fit.fit_groups(cells, "draw", 1, FULL, steps=1)


@pytest.fixture(scope="module")
def fitted(spark, data):
    cells = to_cells(data, FULL).cache()
    draws = bootstrap.multinomial_draws(data, "study", FULL, 40).cache()
    return cells, draws


def test_draws_survive_an_empty_cell(spark):
    df = spark.createDataFrame(
        [(i, "g1" if i % 2 else "g2", LEVELS[i % 3]) for i in range(60)]
        + [(100, "g3", "a")],
        "study int, g string, d string",
    )
    out = bootstrap.multinomial_draws(df, "study", SATURATED, 15).collect()
    assert len({r["draw"] for r in out}) == 15
    assert all(math.isfinite(r["estimate"]) and abs(r["estimate"]) < 60 for r in out)


def test_probabilities_sum_to_one(spark, data, fitted):
    _, draws = fitted
    grid = predict.covariate_grid(data, "g", "year")
    assert grid.count() == 21
    out = predict.epred_draws(grid, draws, FULL, 40)
    assert out.count() == 21 * 40 * 3
    worst = out.groupBy("g", "year", "draw").agg(F.sum("epred").alias("s")).agg(
        F.max(F.abs(F.col("s") - 1))
    ).first()[0]
    assert worst < 1e-9


def test_epred_equals_softmax_by_hand(spark, data, fitted):
    _, draws = fitted
    grid = spark.createDataFrame([("g2", 2004)], "g string, year int")
    got = {
        (r["draw"], r["d"]): r["epred"] for r in predict.epred_draws(grid, draws, FULL, 40).collect()
    }
    for draw in (1, 40):
        beta = np.vstack([np.zeros((1, 4)), as_matrix(draws.filter(F.col("draw") == draw).collect(), FULL)])
        p = np.exp(beta @ np.array([1.0, 2004.0, 1.0, 0.0]))
        p /= p.sum()
        for k, d in enumerate(LEVELS):
            assert got[(draw, d)] == pytest.approx(p[k])


def test_curve_and_slope(spark, data, fitted):
    cells, draws = fitted
    curve = predict.conditional_curve(cells, draws, FULL, "year", 40, points=11).collect()
    assert len(curve) == 33
    assert {r["year"] for r in curve} >= {2000.0, 2006.0}
    assert all(r["lower"] <= r["point"] <= r["upper"] for r in curve)
    slopes = {r["d"]: r for r in predict.average_slope(cells, draws, FULL, "year", 40).collect()}
    assert slopes["a"]["lower"] < 0.06 < slopes["a"]["upper"]
    assert slopes["a"]["lower"] > 0
    per_draw = sum(r["point"] for r in slopes.values())
    assert per_draw == pytest.approx(0.0, abs=0.01)


def test_coefficient_summary_and_check(spark, data, fitted):
    cells, draws = fitted
    table = predict.coefficient_summary(draws).collect()
    assert len(table) == 2 * 4
    assert all(r["conf_low"] <= r["estimate"] <= r["conf_high"] for r in table)
    check = predict.predictive_check(cells, draws, FULL, 40).collect()
    assert sum(r["observed"] for r in check) == data.count()
    assert all(r["lower"] <= r["observed"] <= r["upper"] for r in check)


def test_saturated_draws_reproduce_weighted_shares(spark, data):
    draws = bootstrap.multinomial_draws(data, "study", SATURATED, 5, prior_sd=None)
    grid = data.select("g").distinct()
    got = predict.epred_draws(grid, draws, SATURATED, 5)
    w = bootstrap.bootstrap_cells(data, "study", ["g", "d"], 5)
    total = w.groupBy("draw", "g").agg(F.sum("n").alias("t"))
    both = got.join(w, ["draw", "g", "d"]).join(total, ["draw", "g"])
    assert both.count() == 45
    assert both.agg(F.max(F.abs(F.col("epred") - F.col("n") / F.col("t")))).first()[0] < 1e-7


def test_spline_is_linear_outside_the_knots(spark):
    df = spark.createDataFrame([(float(v),) for v in range(-5, 16)], "x double")
    y = {r["x"]: r["s"] for r in splines.spline_features(df, "x", "s", at=[0.0, 5.0, 10.0]).collect()}
    assert all(y[float(v)] == 0.0 for v in range(-5, 1))
    steps = [y[v + 1.0] - y[float(v)] for v in range(10, 15)]
    assert steps == pytest.approx([steps[0]] * 5)
    assert y[5.0] == pytest.approx(125 / 100)


def test_a_model_against_itself_scores_zero(spark, data):
    out = compare.elpd_compare(data, "study", {"one": FULL, "two": FULL}, folds=3).collect()
    assert [round(r["elpd_diff"], 9) for r in out] == [0.0, 0.0]
    assert [round(r["se_diff"], 9) for r in out] == [0.0, 0.0]


def test_score_matches_rows_by_hand(spark, data):
    """Held-out scores and the standard error from cells equal those from single rows."""
    models = {"full": FULL, "flat": SATURATED}
    out = {r["model"]: r for r in compare.elpd_compare(data, "study", models, folds=3).collect()}
    pdf = data.withColumn("fold", compare.fold_of("study", 3)).toPandas()
    logs = {}
    for name, design in models.items():
        score = np.zeros(len(pdf))
        for f in (1, 2, 3):
            train = pdf[pdf.fold != f].groupby([*design.covariates, "d"]).size().reset_index(name="n")
            beta = newton(
                design.matrix(train), train["d"].map({v: i for i, v in enumerate(LEVELS)}).to_numpy(),
                train["n"].to_numpy(dtype=float), 3, fit.PRIOR_SD,
            )
            held = (pdf.fold == f).to_numpy()
            eta = design.matrix(pdf[held]) @ beta.T
            lp = eta - np.log(np.exp(eta - eta.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - eta.max(axis=1, keepdims=True)
            score[held] = lp[np.arange(held.sum()), pdf[held]["d"].map({v: i for i, v in enumerate(LEVELS)})]
        logs[name] = score
    d = logs["flat"] - logs["full"]
    assert out["full"]["elpd_diff"] == 0.0
    assert out["flat"]["elpd_diff"] == pytest.approx(d.sum(), rel=1e-6)
    assert out["flat"]["se_diff"] == pytest.approx(math.sqrt(len(d)) * d.std(ddof=1), rel=1e-6)


def test_variance_inflation(spark):
    df = spark.range(500).select(F.rand(1).alias("x"), F.rand(2).alias("e"))
    df = df.withColumn("y", F.col("x") + F.col("e")).withColumn("z", F.rand(3))
    r = df.corr("x", "y")
    two = {t.term: t.vif for t in predict.variance_inflation(df, ["x", "y"]).collect()}
    assert two["x"] == pytest.approx(1 / (1 - r * r))
    three = predict.variance_inflation(df, ["x", "y", "z"]).collect()
    assert len(three) == 3 and all(t.vif >= 1 for t in three)


def test_a_fit_is_kept_and_reloaded(spark, data, fitted, tmp_path):
    cells, draws = fitted
    point = fit.multinomial_fit(cells, FULL)
    tables.save_fit(point, draws, str(tmp_path / "fit"))
    p, d = tables.load_fit(spark, str(tmp_path / "fit"))
    assert p.count() == 8 and d.count() == draws.count()


def test_a_separated_fit_has_steps_of_even_cost(spark, monkeypatch):
    """A cell without one category needs dozens of Newton steps; each is planned afresh."""
    import time

    at, stored = [], fit.written_with
    monkeypatch.setattr(fit, "written_with", lambda *a, **k: (at.append(time.perf_counter()), stored(*a, **k))[1])
    heavy = [("a", "g1", 10**7), ("b", "g1", 10**7), ("c", "g1", 10**7), ("a", "g2", 10**7), ("b", "g2", 10**7)]
    cells = spark.createDataFrame(heavy, "d string, g string, n bigint").withColumn("draw", F.lit(1))
    design = Design("d", LEVELS, [], {"g": ["g1", "g2"]})
    got = fit.fit_groups(cells, "draw", 1, design, prior_sd=None).collect()
    beta = as_matrix(got, design)
    assert beta[0] == pytest.approx([0.0, 0.0], abs=1e-9) and beta[1, 1] < -20
    seconds = np.diff(at)[1:]
    assert len(seconds) >= 28  # as many as rounding allows
    assert np.median(seconds[-8:]) < 3 * np.median(seconds[:8]) + 0.5


def test_no_convergence_is_named(spark, data):
    cells = to_cells(data, FULL).withColumn("draw", F.lit(7))
    with pytest.raises(ValueError, match=r"no convergence for draw \[7\]"):
        fit.fit_groups(cells, "draw", 7, FULL, steps=2)


def test_unlisted_levels_raise_in_models(spark, data):
    short = Design("d", ["a", "b"], ["year"], {"g": ["g1", "g2", "g3"]})
    with pytest.raises(Exception, match="d outside the given levels: c"):
        to_cells(data, short).collect()
    known = to_cells(data, FULL)
    draws = fit.fit_groups(known.withColumn("draw", F.lit(1)), "draw", 1, FULL)
    for level in ("g9", None):
        grid = spark.createDataFrame([(2001, level)], "year int, g string")
        with pytest.raises(Exception, match="g outside the given levels"):
            predict.epred_draws(grid, draws, FULL, 1).collect()
    gaps = data.withColumn("g", F.when(F.col("study") > 5, F.col("g")))
    assert to_cells(gaps, FULL).agg(F.sum("n")).first()[0] == data.filter("study > 5").count()


def test_models_come_best_first(spark, data):
    models = {"none": Design("d", LEVELS), "full": FULL, "same": FULL}
    rows = compare.elpd_compare(data, "study", models, 3).collect()
    assert [r["model"] for r in rows] == ["full", "same", "none"]
    assert rows[0]["elpd_diff"] == 0.0 and rows[1]["se_diff"] == 0.0 and rows[2]["elpd_diff"] < 0 < rows[2]["se_diff"]


def test_weights_of_two_clusters_multiply(spark, data):
    """A row's weight is the product of the weights its country and its study have alone."""
    rows = data.withColumn("place", F.col("study") % 7)
    keys = ["place", "study"]
    both = {(r["draw"], r["place"], r["study"]): r["n"] for r in bootstrap.bootstrap_cells(rows, ["place", "study"], keys, 6).collect()}
    count = {(r["place"], r["study"]): r["n"] for r in rows.groupBy(*keys).agg(F.count("*").alias("n")).collect()}
    one = lambda c: F.concat(F.lit(c + "|"), F.col(c).cast("string"))
    draws = spark.range(1, 7).select(F.col("id").cast("int").alias("draw"))
    block = F.floor((F.col("draw") - 1) / 4).cast("int")

    def weight(c):
        h = F.md5(F.concat(one(c), F.lit("|"), block.cast("string")))
        return bootstrap.poisson_weight(F.substr(h, (8 * ((F.col("draw") - 1) % 4) + 1).cast("int"), F.lit(8)))

    alone = rows.select(*keys).distinct().crossJoin(draws).select("draw", *keys, (weight("place") * weight("study")).alias("w"))
    want = {(r["draw"], r["place"], r["study"]): r["w"] * count[r["place"], r["study"]] for r in alone.collect()}
    assert both == {k: v for k, v in want.items() if v}
    assert any(r > 2 for r in want.values())


@pytest.mark.parametrize("held", [1, 40, 1 << 24])
def test_clusters_are_hashed_once_for_all_their_cells(monkeypatch, held):
    """Every weight is that of the plain formula, whatever a task holds; a cluster's cells share its hashes."""
    prefixes = [b"7|", b"8|", b"\\N|"]
    cells = [(p, y, d, 1 + i % 3) for p in prefixes for i, (y, d) in enumerate((y, d) for y in (1, 2, None) for d in "ab")]
    names, draws, calls = ["c", "y", "d", "__c"], 10, []
    table = pa.table({n: pa.array([r[i] for r in cells]) for i, n in enumerate(names)})
    whole = bootstrap.cluster_weights(prefixes, draws)
    for p, row in zip(prefixes, whole):
        for i, w in enumerate(row):
            h = hashlib.md5(p + str(i // 4).encode()).hexdigest()[8 * (i % 4) :][:8]
            assert w == sum(int(h, 16) >= e for e in bootstrap.poisson_edges())
    monkeypatch.setattr(bootstrap, "HELD_SUMS", held)
    monkeypatch.setattr(bootstrap, "md5", lambda b: calls.append(b) or hashlib.md5(b))
    got = {}
    for batch in bootstrap.weighted_cells(table.to_batches(), ["y", "d"], ["c"], draws):
        for r in batch.to_pylist():
            key = (r["draw"], r["y"], r["d"])
            got[key] = got.get(key, 0) + r["__n"]
    want = {}
    for p, y, d, c in cells:
        for i, w in enumerate(whole[prefixes.index(p)]):
            want[i + 1, y, d] = want.get((i + 1, y, d), 0) + int(w) * c
    assert got == {k: v for k, v in want.items() if v}
    assert held < 1 << 24 or len(calls) == len(prefixes) * 3


def binomial_by_sums(n, p, u):
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= u:
            return k
    return n


def test_binomial_quantiles(spark):
    rng = np.random.default_rng(0)
    cases = [(int(n), float(p), float(u)) for n in (0, 1, 2, 17, 400) for p in (0.0, 1e-6, 0.03, 0.5, 0.97, 1.0) for u in rng.random(6)]
    df = spark.createDataFrame(cases, "n bigint, p double, u double").withColumn("k", predict.binomial_quantile("n", "p", "u"))
    assert [r["k"] for r in df.collect()] == [0 if p <= 0 else n if p >= 1 else binomial_by_sums(n, p, u) for n, p, u in cases]
    big = spark.range(4000).select(F.lit(10**9).cast("long").alias("n"), F.lit(0.25).alias("p"), ((F.col("id") + 0.5) / 4000).alias("u"))
    z = np.array([r[0] for r in big.select((predict.binomial_quantile("n", "p", "u") - 0.25e9) / math.sqrt(10**9 * 0.1875)).collect()])
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and (np.diff(z) >= 0).all()


def test_replicated_cells_keep_their_rows_and_widen_the_bands(spark, data):
    cells = to_cells(data, FULL)
    draws = fit.fit_groups(cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(60)))), "draw", 60, FULL)
    weights = cells.groupBy("year", "g").agg(F.sum("n").alias("__n"))
    new = predict.replicated(predict.over_draws(weights, draws, FULL, 60), FULL, ["year", "g"], "__n", "a").collect()
    assert all(r["__y0"] + r["__y1"] + r["__y2"] == r["__n"] and min(r["__y0"], r["__y1"], r["__y2"]) >= 0 for r in new)
    mean = np.mean([r["__y0"] - r["__n"] * r["__p0"] for r in new])
    assert abs(mean) < 1.0
    # All draws are the same fit here: expected counts have no spread, drawn ones do.
    still = predict.predictive_check(cells, draws, FULL, 60).collect()
    drawn = predict.predictive_check(cells, draws, FULL, 60, seed="a").collect()
    assert all(r["upper"] - r["lower"] < 1e-6 for r in still)
    for r in drawn:
        spread = math.sqrt(r["observed"] * (1 - r["observed"] / 6000))
        assert 2.0 * spread < r["upper"] - r["lower"] < 6.0 * spread
    again = predict.predictive_check(cells, draws, FULL, 60, seed="a").collect()
    assert sorted(map(str, again)) == sorted(map(str, drawn))


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_grids_are_whole_and_bounded(spark, monkeypatch, block):
    monkeypatch.setattr(predict, "GRID_BLOCK", block)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "b"), (2, None), (4, "c")], "x int, s string")
    got = {tuple(r) for r in predict.covariate_grid(df, "x", "s").collect()}
    assert got == {(x, s) for x in (1, 2, None, 4) for s in ("a", "b", "c", None)}
    assert predict.covariate_grid(df.filter("false"), "x", "s").count() == 0
    with pytest.raises(ValueError, match="more than 15 rows"):
        predict.covariate_grid(df, "x", "s", most=15)


@pytest.mark.parametrize("prior_sd", [None, 2.5])
def test_left_out_studies_against_refits(spark, data, prior_sd):
    """One Newton step is within 0.02 a study of fitting all others anew; ordered, best first."""
    few = data.filter("study < 40")
    design = Design("d", LEVELS, ["year"], {"g": ["g1", "g2", "g3"]})
    cells = few.groupBy("study", "year", "g", "d").agg(F.count("*").alias("n"))
    got = {r["__study"]: r["s"] for r in compare.study_scores(cells, "study", design, prior_sd, "s").collect()}
    pdf = few.groupBy("study", "year", "g", "d").agg(F.count("*").alias("n")).toPandas()
    assert len(got) == 40
    for study in (0, 7, 23, 39):
        rest, own = pdf[pdf["study"] != study], pdf[pdf["study"] == study]
        beta = as_matrix(fit_frame(rest, design, "n", prior_sd).to_dict("records"), design)
        eta = np.column_stack([np.zeros(len(own)), design.matrix(own) @ beta.T])
        logp = eta - np.log(np.exp(eta).sum(axis=1, keepdims=True))
        want = sum(n * logp[i, LEVELS.index(d)] for i, (d, n) in enumerate(zip(own["d"], own["n"])))
        assert got[str(study)] == pytest.approx(want, abs=0.02)
    models = {"none": Design("d", LEVELS), "full": design}
    rows = compare.elpd_loo(data, "study", models, prior_sd).collect()
    assert [r["model"] for r in rows] == ["full", "none"] and rows[1]["elpd_diff"] < 0 < rows[1]["se_diff"]


def test_left_out_studies_are_whole_and_stepped_together(spark, data, monkeypatch):
    """A study over several batches, null or not, has one score; no Python call per study."""
    design = Design("d", LEVELS, ["year"], {"g": ["g1", "g2", "g3"]})
    rows = data.withColumn("study", F.when(F.col("study") < 9, F.lit(None)).otherwise(F.col("study")))
    cells = rows.groupBy("study", "year", "g", "d").agg(F.count("*").alias("n")).cache()
    other = Design("d", LEVELS[::-1], [], {"g": ["g1", "g2", "g3"]})
    plan = compare.left_out_scores(cells, "study", {"__a": design, "__b": other}, 2.5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in text and "FlatMapGroupsInPandas" not in text and text.count("Exchange hashpartitioning(__study") == 1
    want = {r["__study"]: tuple(r) for r in plan.collect()}
    assert len(want) == 392 and sum(r[1] for r in want.values()) == 6000 and want[None][1] == 135
    one = {r["__study"]: r["__b"] for r in compare.study_scores(cells, "study", other, 2.5, "__b").collect()}
    assert all(one[k] == pytest.approx(r[3]) for k, r in want.items())
    monkeypatch.setattr(compare, "BLOCK", 1)  # a study at a time
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        small = {r["__study"]: tuple(r) for r in compare.left_out_scores(cells, "study", {"__a": design, "__b": other}, 2.5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert small.keys() == want.keys()
    assert all(small[k][1:] == pytest.approx(r[1:]) for k, r in want.items())


def test_sums_by_study_in_tiles(monkeypatch):
    """Gradients, curvatures and scores of many groups at once are those of each alone, in any tiles."""
    rng, of = np.random.default_rng(3), np.repeat([0, 1, 2], [1, 6, 4])
    near = compare.Local(SATURATED, rng.normal(size=(2, 3)), np.zeros(0), None)
    x, y = np.column_stack([np.ones(11), rng.integers(0, 2, (11, 2))]), rng.integers(0, 5, (11, 3)).astype(float)
    whole = 50 * np.eye(6)
    alone = [near.sums(x[of == i], y[of == i], np.zeros((of == i).sum(), dtype=int), 1) for i in range(3)]
    scores = [near.left_out(x[of == i], y[of == i], np.zeros((of == i).sum(), dtype=int), 1, whole)[0] for i in range(3)]
    for block in (1, 30, 1 << 20):
        monkeypatch.setattr(compare, "BLOCK", block)
        gradient, curvature = near.sums(x, y, of, 3)
        assert gradient == pytest.approx(np.array([g[0] for g, _ in alone]))
        assert curvature == pytest.approx(np.array([c[0] for _, c in alone]))
        assert near.left_out(x, y, of, 3, whole) == pytest.approx(np.array(scores))


def test_a_model_read_in_another_session_predicts_the_same(spark, data, tmp_path):
    cells = to_cells(data, FULL)
    model = estimator.Multinomial(FULL).fit(cells)
    path = str(tmp_path / "model")
    model.write().save(path)
    with pytest.raises(Exception, match="exist|EXISTS"):
        model.write().save(path)
    model.write().overwrite().save(path)
    grid = [(2001, "g1"), (2006, "g3")]
    want = [r["probability"] for r in model.transform(spark.createDataFrame(grid, "year int, g string")).collect()]
    other = spark.newSession()
    found = estimator.MultinomialModel.load(path)
    assert found.design.terms == model.design.terms and list(found.design.levels) == LEVELS
    got = [r["probability"] for r in found.transform(spark.createDataFrame(grid, "year int, g string")).collect()]
    assert got == want and all(sum(p) == pytest.approx(1) for p in got)
    assert other.read.parquet(f"{path}/coefficients").count() == 8
    with pytest.raises(Exception, match="g outside the given levels"):
        found.transform(spark.createDataFrame([(2001, "g9")], "year int, g string")).collect()
