"""Order statistics over more rows than a sample holds, in many ranges: equal to numpy, with and without adaptive execution, and the same twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectum.operators import features, hypothesis, matching, ranges, regression, uplift

N = 3_000_000


@pytest.fixture(scope="module", params=["true", "false"])
def wide(spark, request):
    """The session with 16 partitions, and 3,000,000 rows with a skewed value without ties, one with ties, and an arm."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    i = F.pmod(F.col("id") * 2654435761, F.lit(4294967291))
    df = spark.range(N).select("id", (F.pow(i.cast("double"), 2) / 1e9).alias("v"), F.pmod(F.floor(i / 7), F.lit(5000)).cast("double").alias("tied"), (F.pmod(F.xxhash64("id"), F.lit(100)) < 40 + F.pmod(i, F.lit(20))).cast("int").alias("t"))
    yield df
    for k, v in keep.items():
        spark.conf.set(k, v)


def ranks(v: np.ndarray) -> np.ndarray:
    _, back, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[back]


def test_running_sums(wide):
    got = ranges.running(wide.select("v", F.lit(1).alias("one")), "v", ["one"])
    s = got.agg(F.count("*"), F.countDistinct("cum_one"), F.min("cum_one"), F.max("cum_one")).first()
    assert list(s) == [N, N, 1, N]
    assert got.withColumn("p", F.pmod(F.xxhash64("v"), F.lit(9))).where("p = 0").join(got.select("v", F.col("cum_one").alias("again")), "v").where("cum_one <> again").isEmpty()


@pytest.mark.parametrize("column", ["v", "tied"])
def test_ranks_equal_numpy(wide, column):
    local = wide.select(F.col(column).alias("v"), "t").toPandas()
    v, t = local["v"].to_numpy(), local["t"].to_numpy()
    p, q = int(t.sum()), int((1 - t).sum())
    u = ranks(v)[t == 1].sum() - p * (p + 1) / 2
    assert hypothesis.mann_whitney_utest(wide, column, "t").first()["u_statistic"] == pytest.approx(u, rel=1e-12)
    assert regression.auc(wide, "t", column).first()[0] == pytest.approx(u / (p * q), rel=1e-12)
    order = np.sort(np.unique(v))
    gap = np.searchsorted(np.sort(v[t == 0]), order, "right") / q - np.searchsorted(np.sort(v[t == 1]), order, "right") / p
    assert hypothesis.kolmogorov_smirnov_test(wide, column, "t").first()["d_statistic"] == pytest.approx(np.abs(gap).max(), rel=1e-9)
    last = regression.roc_curve(wide, "t", column).agg(F.max("fpr"), F.max("tpr")).first()
    assert list(last) == [1, 1]


def test_survival(wide):
    got = features.kaplan_meier(wide, "v").agg(F.count("*"), F.countDistinct("at_risk"), F.max("at_risk"), F.min("survival")).first()
    assert list(got) == [N, N, N, 0]


def test_lift(wide):
    local = wide.select("v", "t", "tied").toPandas().sort_values("v", ascending=False)
    n, t, y = np.arange(1, N + 1), local["t"].to_numpy().cumsum(), local["tied"].to_numpy()
    ty = (local["tied"] * local["t"]).to_numpy().cumsum()
    lift = ty / np.maximum(t, 1) - (y.cumsum() - ty) / np.maximum(n - t, 1)
    got = uplift.get_lift_gain(wide, "v", "tied", "t", K=50, normalize=False).orderBy("bucket").collect()
    at = np.arange(1, 51) * (N // 50) - 1
    assert [r["ratio"] for r in got] == pytest.approx((at + 1) / N)
    assert [r["lift"] for r in got] == pytest.approx(lift[at], rel=1e-9)


def test_lift_of_ties_is_a_mean_over_orders(spark):
    rows = [(1.0, float(i), i % 2) for i in range(10)] + [(0.0, 5.0, 1), (0.0, 3.0, 0)]
    got = uplift.get_lift_gain(spark.createDataFrame(rows, "ite double, y double, t int"), "ite", "y", "t", K=4, normalize=False).orderBy("bucket").collect()
    assert [r["ratio"] for r in got] == pytest.approx([0.25, 0.5, 0.75, 1])
    assert [r["lift"] for r in got][:3] == pytest.approx([1, 1, 1])


def test_matching_numbers_every_row_once(wide):
    got = matching.caliper_matching(wide.withColumn("score", F.lit(0.5)), "t", "score", 0.2, order=["v"]).where("matching_index <> 0")
    p = wide.agg(F.sum("t")).first()[0]
    s = got.groupBy("t").agg(F.count("*").alias("n"), F.countDistinct("matching_index").alias("d"), F.max(F.abs("matching_index")).alias("m")).collect()
    assert {(r["t"], r["n"], r["d"], r["m"]) for r in s} == {(0, min(p, N - p), min(p, N - p), min(p, N - p)), (1, min(p, N - p), min(p, N - p), min(p, N - p))}


def test_exact_quantiles_equal_percentile_without_its_map(spark):
    """Values without ties and with many, few rows, nulls, NaN and no rows. No task has all distinct values, as it had in Spark's percentile."""
    levels = [0, 0.001, 0.25, 0.333, 0.5, 0.75, 0.9999, 1]
    many = spark.range(30_000).selectExpr("pow(pmod(id * 7919, 30011), 2) / 7 as v", "pmod(id, 40) as tied")
    few = spark.createDataFrame([(1.0,), (None,), (2.5,), (float("nan"),), (2.5,), (-7.0,)], "v double")
    for df, c in ((many, "v"), (many, "tied"), (few, "v"), (few.where("v = 1"), "v")):
        want = df.agg(F.expr(f"percentile({c}, array({', '.join(map(str, levels))}))")).first()[0]
        for accuracy in (10_000, 10):
            assert ranges.exact_quantiles(df, c, levels, accuracy) == pytest.approx(want, rel=1e-12, nan_ok=True)
    assert ranges.exact_quantiles(few.where("v is null"), "v", levels) == [None] * len(levels)
    assert "percentile(" not in features.five_numbers(many, "v")._jdf.queryExecution().executedPlan().toString()
