import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectum.functions import distributions as d
from effectum.functions import scalar
from effectum.operators import features, hypothesis, matching, regression, resampling, uplift
from effectum.operators.moments import MeanFunction, Moments


def test_distributions():
    assert d.norm_cdf(1.96) == pytest.approx(0.9750021048517795, rel=1e-12)
    assert d.norm_ppf(0.975) == pytest.approx(1.959963984540054, rel=1e-12)
    assert d.t_cdf(2.0, 5) == pytest.approx(0.9490302605850709, rel=1e-10)
    assert d.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert d.f_sf(3.0, 2, 10) == pytest.approx(0.0953674316, rel=1e-6)
    assert d.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert d.chi2_sf(30.0, 10) == pytest.approx(0.000856641210775301, rel=1e-8)
    assert d.t_cdf(0.3, 1e6) == pytest.approx(d.norm_cdf(0.3), abs=1e-6)


def test_column_erf_and_gamma(spark):
    xs = [-5.0, -2.5, -1.0, -0.1, 0.0, 0.3, 1.0, 2.0, 3.5, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", d.erf(F.col("x")).alias("e"), scalar.erfc("x").alias("c")).collect()
    for r in got:
        assert r["e"] == pytest.approx(math.erf(r["x"]), abs=1e-14)
        assert r["c"] == pytest.approx(math.erfc(r["x"]), rel=1e-9)
    ys = [0.1, 0.5, 1.0, 2.5, 10.0, 100.0, -0.5, -2.3]
    for r in spark.createDataFrame([(y,) for y in ys], "y double").select("y", scalar.lgamma("y").alias("l"), scalar.tgamma("y").alias("g")).collect():
        assert r["l"] == pytest.approx(math.lgamma(r["y"]), rel=1e-10, abs=1e-12)
        if abs(r["y"]) < 50:
            assert r["g"] == pytest.approx(math.gamma(r["y"]), rel=1e-9)
    assert spark.range(1).select(scalar.lgamma(F.lit(-2.0)).alias("p")).first()["p"] is None


def test_hashes_of_known_values(spark):
    assert scalar.murmur3_32_of(b"") == 0
    assert scalar.murmur3_32_of(b"test") == 0xBA6BD213
    assert scalar.murmur3_32_of(b"Hello, world!") == 0xC0363E43
    assert scalar.murmur3_64_of(b"") == 0
    r = spark.createDataFrame([("test",), (None,)], "s string").select(scalar.murmur_hash3_32("s").alias("h"), scalar.murmur_hash3_64("s").alias("k")).collect()
    assert r[0]["h"] == 0xBA6BD213 and r[1]["h"] is None
    assert int(r[0]["k"]) == scalar.murmur3_64_of(b"test")


def test_division_by_zero_is_null(spark):
    r = spark.createDataFrame([(1.0, 0.0)], "a double, b double").select(scalar.divide("a", "b").alias("q"), scalar.modulo("a", "b").alias("m"), scalar.cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first()
    assert list(r) == [None, None, None]


def test_mean_function_gradient():
    f = MeanFunction("-avg(x) / (avg(y) * 3)")
    v = f(np.array([3.0, 2.0]))
    assert v.value == pytest.approx(-0.5) and v.grad[1] == pytest.approx(0.25)
    assert MeanFunction("a / b").args == ["a", "b"]
    assert MeanFunction("avg(case when (a > 1) then 1 else 0 end) + avg(x)").args[0] == "case when (a > 1) then 1 else 0 end"
    with pytest.raises(ValueError):
        MeanFunction("avg(x) ** 2")


def test_moments_merge_equals_whole():
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1, (100, 3))
    of = lambda a: Moments(len(a), a.mean(0), np.cov(a.T, bias=True))
    m = Moments.merge([of(x[:30]), of(x[30:])])
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.cov, np.cov(x.T, bias=True))


@pytest.fixture(scope="module")
def trial(spark):
    return uplift.simulate_randomized_trial(spark, n=3000, p=3, add_cost_benefit=True).cache()


def test_ttest_against_numpy(trial):
    p = trial.toPandas()
    a, b = p[p.treatment == 0].outcome, p[p.treatment == 1].outcome
    r = hypothesis.ttest_2samp(trial, "avg(outcome)", "treatment").first()
    se = math.sqrt(a.var() / len(a) + b.var() / len(b))
    assert r["estimate"] == pytest.approx(b.mean() - a.mean()) and r["stderr"] == pytest.approx(se)
    less = hypothesis.ttest_2samp(trial, "avg(outcome)", "treatment", alternative="less").first()
    assert less["lower"] == -math.inf and less["p_value"] == pytest.approx(d.norm_cdf(r["t_statistic"]))
    cuped = hypothesis.ttest_2samp(trial, "avg(outcome)", "treatment", x="avg(x0) + avg(x1)").first()
    assert cuped["stderr"] < r["stderr"]


def test_partitioning_does_not_matter(trial):
    one = hypothesis.ttest_2samp(trial.coalesce(1), "avg(outcome) / avg(x0)", "treatment").first()
    many = hypothesis.ttest_2samp(trial.repartition(7), "avg(outcome) / avg(x0)", "treatment").first()
    assert list(one) == pytest.approx(list(many), rel=1e-9)


@pytest.mark.parametrize("condition", ["false", "treatment = 0"])
def test_empty_and_single_arm_inputs(trial, condition):
    df = trial.where(condition)
    for f in (hypothesis.ttest_2samp, hypothesis.student_ttest, hypothesis.welch_ttest):
        rows = f(df, "avg(outcome)" if f is hypothesis.ttest_2samp else "outcome", "treatment").collect()
        assert all(v is None for r in rows for v in r)
    assert list(hypothesis.mann_whitney_utest(df, "outcome", "treatment").first()) == [None, None]
    assert list(hypothesis.kolmogorov_smirnov_test(df, "outcome", "treatment").first()) == [None, None]
    assert hypothesis.xexpt_ttest_2samp(df, "outcome", "x0", "treatment", "unit").count() == 0
    if condition == "false":
        assert hypothesis.delta_method(df, "avg(outcome)").first()[0] is None
        assert all(v is None for v in hypothesis.ttest_1samp(df, "avg(outcome)").first())
        regression.ols(df, "outcome ~ x0").collect()


def test_nulls_are_left_out(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, None), (1, 3.0), (1, 5.0), (None, 9.0)], "t int, y double")
    r = hypothesis.ttest_2samp(df, "avg(y)", "t").first()
    assert (r["mean0"], r["mean1"]) == (1.5, 4.0)


def test_zero_error(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0)], "t int, y double")
    r = hypothesis.ttest_2samp(df, "avg(y)", "t").first()
    assert r["t_statistic"] == 0 and r["p_value"] == 1
    r = hypothesis.ttest_2samp(df.withColumn("y", F.col("y") + F.col("t")), "avg(y)", "t").first()
    assert r["t_statistic"] == math.inf and r["p_value"] == 0


def test_ols_against_numpy(trial):
    p = trial.toPandas()
    x = np.column_stack([p.x0, p.x1, np.ones(len(p))])
    b, *_ = np.linalg.lstsq(x, p.outcome, rcond=None)
    model = regression.fit_ols(trial, "outcome ~ x0 + x1")
    assert model.coef == pytest.approx(b)
    e = p.outcome - x @ b
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(p) - 3))
    assert [r[2] for r in model.rows()] == pytest.approx(list(se))
    w = regression.fit_wls(trial, "outcome ~ x0 + x1", "x2")
    bw = np.linalg.solve(x.T @ (x * p.x2.to_numpy()[:, None]), x.T @ (p.x2 * p.outcome))
    assert w.coef == pytest.approx(bw)
    none = regression.fit_ols(trial, "outcome ~ x0 + x1 - 1")
    assert none.coef == pytest.approx(np.linalg.lstsq(x[:, :2], p.outcome, rcond=None)[0]) and none.df == len(p) - 3


def test_collinear_column_has_no_coefficient(trial):
    model = regression.fit_ols(trial, "outcome ~ x0 + 2 * x0 + x1")
    assert math.isnan(model.coef[1]) and not math.isnan(model.coef[2])
    assert trial.select(F.sum(model.predict())).first()[0] is not None


def test_iv_matches_two_stages(trial):
    p = trial.toPandas()
    z = np.column_stack([p.treatment, p.x1, np.ones(len(p))])
    hat = z @ np.linalg.lstsq(z, p.x0 + p.treatment, rcond=None)[0]
    x = np.column_stack([hat, p.x1, np.ones(len(p))])
    b = np.linalg.lstsq(x, p.outcome, rcond=None)[0]
    e = p.outcome - np.column_stack([p.x0 + p.treatment, p.x1, np.ones(len(p))]) @ b
    inv = np.linalg.inv(x.T @ x)
    cov = inv @ (x.T * (e.to_numpy() ** 2)) @ x @ inv
    model = regression.fit_iv(trial.withColumn("d", F.col("x0") + F.col("treatment")), "outcome ~ (d ~ treatment) + x1")
    assert model.coef == pytest.approx(b) and [r[2] for r in model.rows()] == pytest.approx(list(np.sqrt(np.diag(cov))))


def test_logistic_gradient_vanishes(trial):
    df = trial.withColumn("hit", (F.col("outcome") > 1).cast("int"))
    m = regression.Logistic().fit("hit", ["x0", "treatment"], df)
    scored = m.predict(df)
    g = scored.select(*[F.sum((F.col("hit") - F.col("prob")) * F.col(c)) for c in ("x0", "treatment")]).first()
    assert list(g) == pytest.approx([0, 0], abs=1e-5)
    assert 0.5 < m.get_auc(scored, "hit") < 1


def test_bootstrap_is_reproducible_and_fair(trial):
    a = [r["value"] for r in resampling.boot_strap(trial, "avg(outcome)", "unit", n_resamples=60).orderBy("replicate").collect()]
    b = [r["value"] for r in resampling.boot_strap(trial.repartition(5), "avg(outcome)", "unit", n_resamples=60).orderBy("replicate").collect()]
    assert a == pytest.approx(b)
    se = trial.select(F.stddev_samp("outcome") / F.sqrt(F.count("*"))).first()[0]
    assert np.std(a, ddof=1) == pytest.approx(se, rel=0.35)
    with pytest.raises(ValueError):
        resampling.boot_strap(trial, "avg(outcome)", "unit", n_resamples=0)


def test_permutation_has_no_effect(trial):
    v = [r["value"] for r in resampling.permutation(trial, "avg(outcome)", "treatment", "unit", permutation_num=60, statistic="t").collect()]
    assert abs(np.mean(v)) < 0.5 and 0.6 < np.std(v) < 1.5
    shifted = [r["value"] for r in resampling.permutation(trial, "avg(outcome)", "treatment", "unit", permutation_num=20, mde=1.0, mde_type=0).collect()]
    assert np.mean(shifted) == pytest.approx(1, abs=0.1)


def test_learners_find_the_effect(trial):
    for kind in (uplift.SLearner, uplift.TLearner, uplift.XLearner):
        r = kind("outcome", "treatment", ["x0", "x1", "x2"]).fit(trial).predict(trial).select(F.avg("cate_outcome"), F.avg("tau"), F.corr("cate_outcome", "tau")).first()
        assert r[0] == pytest.approx(r[1], abs=0.15) and r[2] > 0.5
    dml = uplift.LinearDML("unit").fit(trial, "outcome", "treatment", ["x0"], ["x1", "x2"])
    lo, hi = dml.ate_interval()
    assert lo < dml.ate() < hi and dml.ate() == pytest.approx(0.5, abs=0.15)


def test_learners_with_base_models(trial):
    """A step in x0 that no linear model sees is found by learners over MLlib's trees; rows with a null feature get null."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import DecisionTreeRegressor

    df = trial.withColumn("y", F.when(F.abs(F.col("x0") - 0.5) > 0.25, 4.0 * F.col("treatment")).otherwise(0.0)).withColumn("effect", F.when(F.abs(F.col("x0") - 0.5) > 0.25, 4.0).otherwise(0.0))
    for kind in (uplift.SLearner, uplift.TLearner, uplift.XLearner, uplift.TransformedOutcome):
        got = kind("y", "treatment", ["x0", "x1"], base_model=DecisionTreeRegressor, base_model_params={"maxDepth": 5}).fit(df).predict(df)
        assert got.columns == [*df.columns, "cate_outcome"] and got.count() == df.count()
        assert got.select(F.corr("cate_outcome", "effect")).first()[0] > 0.85
        linear = kind("y", "treatment", ["x0", "x1"]).fit(df).predict(df)
        assert abs(linear.select(F.corr("cate_outcome", "effect")).first()[0]) < 0.6
    holes = df.withColumn("x0", F.when(F.col("x1") > 0, F.col("x0")))
    got = uplift.TLearner("y", "treatment", ["x0", "x1"], base_model=DecisionTreeRegressor).fit(holes).predict(holes)
    assert got.where("(x0 is null) <> (cate_outcome is null)").count() == 0
    p = uplift.Propensity("y", "treatment", ["x0", "x1"], base_model=RandomForestClassifier, base_model_params={"seed": 1}).fit(df).predict(df, "p")
    assert 0 < p.agg(F.min("p")).first()[0] and p.agg(F.max("p")).first()[0] < 1 and p.agg(F.avg("p")).first()[0] == pytest.approx(0.5, abs=0.05)


@pytest.mark.parametrize("alternative", ["two-sided", "less", "greater"])
def test_exact_kolmogorov_smirnov(spark, alternative):
    """Equal to counting all orders of small samples; near the limit law for large ones."""
    from itertools import combinations

    from effectum.operators import hypothesis

    for n0, n1 in ((5, 4), (3, 7), (6, 6), (1, 4)):
        gaps = []
        for own in combinations(range(n0 + n1), n0):
            f = np.cumsum([1 / n0 if k in own else -1 / n1 for k in range(n0 + n1)])
            gaps.append({"two-sided": np.abs(f).max(), "greater": max(f.max(), 0), "less": max(-f.min(), 0)}[alternative])
        for d in sorted(set(np.round(gaps, 9))):
            assert hypothesis.kolmogorov_exact_sf(n0, n1, d, alternative) == pytest.approx(np.mean(np.array(gaps) >= d - 1e-9), abs=1e-12)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(rng.normal(size=8000) + np.arange(8000) % 2 * 0.03)], "v double, t int")
    exact, limit = (hypothesis.kolmogorov_smirnov_test(df, "v", "t", alternative=alternative, mode=m).first() for m in ("auto", "asymp"))
    assert exact["d_statistic"] == limit["d_statistic"] and exact["p_value"] == pytest.approx(limit["p_value"], abs=0.02) and exact["p_value"] != limit["p_value"]


def test_table_name(spark):
    from effectum.frame import Frame

    f = Frame(spark.range(7))
    name = f.getTableName()
    assert name == f.getTableName() and spark.sql(f"select count(*) from {name}").first()[0] == 7


def test_too_many_levels(spark):
    from effectum.operators.features import OneHotEncoder

    with pytest.raises(ValueError):
        OneHotEncoder().fit(spark.range(5000), ["id"])


def test_trees_and_forest(trial, tmp_path):
    df = trial.withColumn("y", F.when(F.col("x0") > 0.5, 3.0 * F.col("treatment")).otherwise(0.0) + F.col("x1"))
    tree = uplift.CausalTree("unit", depth=2, min_arm=30).fit("y", "treatment", ["x0", "x1"], df)
    assert tree.nodes[0].split[0] == "x0" and tree.nodes[0].split[1] == pytest.approx(0.5, abs=0.06)
    means = {r["high"]: r["e"] for r in tree.effect(df).groupBy((F.col("x0") > 0.55).alias("high")).agg(F.avg("effect").alias("e")).collect()}
    assert means[True] == pytest.approx(3, abs=0.3) and means[False] == pytest.approx(0.15, abs=0.4)
    stored = uplift.predict_by_rules(df, tree.rules(df)).join(tree.effect(df).select("unit", F.col("effect").alias("e")), "unit")
    assert stored.where("effect <=> e").count() == df.count()
    uplift.save_model(tree, str(tmp_path / "t"))
    assert uplift.load_model(str(tmp_path / "t")).get_decision_rules() == tree.get_decision_rules()
    forest = uplift.CausalForest("unit", depth=2, num_trees=5, mtry=2).fit("y", "treatment", ["x0", "x1"], df)
    f = {r["high"]: r["e"] for r in forest.effect(df).groupBy((F.col("x0") > 0.55).alias("high")).agg(F.avg("effect").alias("e")).collect()}
    assert f[True] > 2 and f[False] < 1
    assert forest.variable_importance()["x0"] > 0


def test_qini_prefers_the_true_effect(trial):
    good = uplift.compute_qini_coefficient(uplift.estimate_qini(trial, score="tau", n_buckets=10))
    bad = uplift.compute_qini_coefficient(uplift.estimate_qini(trial.withColumn("s", -F.col("tau")), score="s", n_buckets=10))
    assert good > bad


def test_matching_is_balanced(trial):
    m = matching.caliper_matching(trial, "treatment", "x0", 0.05, order=["unit"])
    r = m.groupBy(F.abs("matching_index").alias("i")).agg(F.count("*").alias("n"), F.sum("treatment").alias("t"), (F.max("x0") - F.min("x0")).alias("gap")).where("i > 0").collect()
    assert all(x["n"] == 2 and x["t"] == 1 and x["gap"] <= 0.05 for x in r)
    assert sorted(x["i"] for x in r) == list(range(1, len(r) + 1))
    nulls = trial.withColumn("x0", F.when(F.col("unit") > 5, F.col("x0")))
    assert matching.caliper_matching(nulls, "treatment", "x0", 0.05, order=["unit"]).where("unit <= 5 and matching_index <> 0").count() == 0


def test_kaplan_meier_with_censoring(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (4, 0)], "t int, e int")
    got = [(r["time"], r["at_risk"], r["events"], round(r["survival"], 6)) for r in features.kaplan_meier(df, "t", "e").orderBy("time").collect()]
    assert got == [(1, 5, 1, 0.8), (2, 4, 0, 0.8), (3, 3, 2, round(0.8 / 3, 6)), (4, 1, 0, round(0.8 / 3, 6))]
    assert features.kaplan_meier(df.where("t = 3"), "t", "e").first()["survival"] == 0


@pytest.mark.parametrize("cells", [1_000_000, 0])
def test_forest_equals_brute_force(spark, monkeypatch, cells):
    """20 trees of depth 5, grown from sums of cells and level by level: the effect of a row is the mean over trees of its honest leaf, as its rules say."""
    monkeypatch.setattr(uplift.CausalForest, "CELLS", cells)
    df = spark.range(6000).selectExpr("id", "pmod(xxhash64(id), 50) / 5d as a", "if(id % 9 = 0, null, pmod(xxhash64(id, 1), 40)) as b", "cast(id % 2 as int) as t").withColumn("y", F.expr("if(id % 31 = 0, null, a * t + b % 3)"))
    forest = uplift.CausalForest("id", mtry=2).fit("y", "t", ["a", "b"], df)
    effect = F.col("effect")
    plan = forest.effect(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE") < 1500  # each split once, not once for each leaf of its tree
    got = forest.effect(df).select("id", "effect").toPandas().set_index("id")["effect"]
    halves = forest._members(df.select("id", F.col("id").alias("__key"))).where("half = 1").groupBy("tree").agg(F.collect_set("id").alias("ids"))
    honest = {r["tree"]: set(r["ids"]) for r in halves.collect()}
    rows = df.toPandas().set_index("id")
    known = []
    for k, tree in enumerate(forest.members):
        own = rows[rows.index.isin(honest[k])]
        leaf = lambda frame, tree=tree: np.array([_leaf(tree, r.a, r.b) for r in frame.itertuples()])
        at, means = leaf(own), {}
        for n in tree.leaves():
            arm = [own["y"][(at == n.id) & (own["t"] == a)].mean() for a in (0, 1)]
            means[n.id] = arm[1] - arm[0]
            assert n.effect == pytest.approx(means[n.id], rel=1e-9)
        known.append([means[i] for i in leaf(rows)])
    assert max(len(tree.nodes) for tree in forest.members) > 15
    assert got[rows.index].to_numpy() == pytest.approx(np.mean(known, axis=0), rel=1e-9)


def _leaf(tree, a, b) -> int:
    n = tree.nodes[0]
    while n.children:
        n = tree.nodes[n.children[0 if {"__x0": a, "__x1": b}[n.split[0]] <= n.split[1] else 1]]
    return n.id


def test_weighted_sums_equal_the_drawn_rows(spark):
    """The sums equal those over rows copied for each replicate, with nulls in all columns, infinities and a group of nulls; rates below and above 1."""
    df = spark.range(20_000).selectExpr("id", "if(id % 7 = 0, null, concat('k', id)) as k", "if(id % 5 = 0, null, cast(id % 3 as int)) as g", "if(id % 11 = 0, null, id / 7d) as v", "if(id = 4, double('inf'), id % 10) as z", "if(id % 13 = 0, null, 1 / (1d + id % 4)) as w")
    for rate in (0.3, 1.0, 45.0):
        got = resampling.weighted_sums(df, [F.col("v"), F.col("z")], F.col("w"), "k", range(6), rate, 5, [F.col("g")], point=True)
        u = resampling.uniform(5, F.col("k"), F.col("replicate"), "bootstrap")
        rows = resampling.replicated(df, range(6)).withColumn("u", u).withColumn("n", F.when(F.col("replicate") == 0, 1).otherwise(resampling.poisson_weight(F.col("u"), rate))).where("n > 0")
        want = rows.groupBy("replicate", F.col("g").alias("g0")).agg(F.sum(F.col("n") * F.col("w")).alias("w"), F.sum(F.col("n") * F.col("w") * F.col("v")).alias("s0"), F.sum(F.col("n") * F.col("w") * F.col("z")).alias("s1"))
        order = lambda d: sorted((tuple(r) for r in d.collect()), key=lambda r: (r[0], -1 if r[1] is None else r[1]))
        a, b = order(got), order(want)
        assert len(a) == 24 and [r[:2] for r in a] == [r[:2] for r in b]
        assert [r[2:] for r in a] == [pytest.approx(r[2:], rel=1e-12) for r in b]
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # before: each row was copied for each replicate


def test_erf_and_gcd_equal_the_library_without_long_loops(spark):
    """Values about all bounds of the approximations; Fibonacci numbers, which need the most steps, zeros, negative numbers and nulls. Before: 150 and 92 interpreted steps a row."""
    x = [0.0, 1e-9, 0.3, 0.84374, 0.84376, 1.2, 1.2499, 1.2501, 2.0, 2.857, 2.8572, 4.0, 5.9, 6.1, 40.0]
    x += [-v for v in x]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(d.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(v) for v in x], rel=1e-14, abs=1e-300)
    assert "aggregate(" not in str(d.erf(F.col("x")))
    f = [1, 1]
    while f[-1] < 2**62:
        f.append(f[-1] + f[-2])
    pairs = [*zip(f, f[1:], strict=False), *zip(f[1:], f, strict=False), (0, 0), (0, 7), (7, 0), (-12, 18), (2**62, 2**61), (999, 20_000 * 37)]
    out = spark.createDataFrame([*pairs, (None, 3), (3, None)], "a long, b long").select("a", "b", scalar.gcd("a", "b").alias("g")).collect()
    assert all(r["g"] == (None if None in (r["a"], r["b"]) else math.gcd(r["a"], r["b"])) for r in out)
