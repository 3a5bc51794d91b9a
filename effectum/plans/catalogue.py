"""The registered queries, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions import scalar
from ..operators import features, hypothesis, matching, ml_features, regression, resampling, uplift
from ..streaming import windows
from . import relational
from .sql import sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: The 97.5 % point of the normal law.
Z = 1.959963984540054


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the place of each row, ``__row``: files by name, rows as they lie in them. It tells equal values apart as the SQL does, which keeps the first it reads."""
    df = table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = sorted(r[0] for r in df.select("__file").distinct().collect()) if len(df.inputFiles()) > 1 else []
    if files:
        numbers = spark.createDataFrame(list(enumerate(files)), "__number long, __file string")
        df = df.join(F.broadcast(numbers), "__file").withColumn("__row", F.col("__number") * F.lit(1 << 40) + F.col("__row")).drop("__number")
    return df.drop("__file")


def query(oracle: str | None = None, name: str | None = None):
    """Register a function as the query of its name."""

    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if oracle:
            _ORACLE[key] = oracle
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def rounded(df: DataFrame, digits: int = 4, **own: int) -> DataFrame:
    """Doubles rounded, so that the last bits of sums in another order don't show; + 0.0 makes -0.0 plain."""
    return df.select(*[(F.round(c, own.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: str, digits: int = 4) -> str:
    return f"round({x}, {digits}) + 0.0"


def norm_cdf(x: str) -> str:
    """The normal distribution function in SQL, by the series without cancellation."""
    z = f"least(abs({x}), 8.4) / sqrt(2.0)"
    series = f"list_sum(list_transform(range(0, 150), lambda n: exp(n * ln(4 * ({z}) * ({z})) + lgamma(n + 1) - lgamma(2 * n + 2))))"
    return f"(case when {x} = 0 then 0.5 else 0.5 + sign({x}) * ({z}) / sqrt(pi()) * exp(-({z}) * ({z})) * {series} end)"


def t_quantile(df: str) -> str:
    """The 97.5 % point of Student's law for many degrees of freedom (Cornish and Fisher's expansion)."""
    z = Z
    a, b, c = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return f"({z!r} + {a!r} / ({df}) + {b!r} / (({df}) * ({df})) + {c!r} / (({df}) * ({df}) * ({df})))"


ARM = "cast(l_orderkey % 2 as int)"

# Tests

_RATIO = f"""
g as (select {{by}}{ARM} as t, count(*) as n, avg(l_extendedprice) as my, avg(l_quantity) as mx, var_samp(l_extendedprice) as vy, var_samp(l_quantity) as vx, covar_samp(l_extendedprice, l_quantity) as c
      from lineitem group by all),
v as (select *, my / mx as m, (vy / (mx * mx) - 2 * my * c / (mx * mx * mx) + my * my * vx / (mx * mx * mx * mx)) / n as var from g)"""


@query(
    f"""with {_RATIO.format(by="")},
p as (select max(case when t = 0 then m end) as mean0, max(case when t = 1 then m end) as mean1, sqrt(sum(var)) as stderr, sum(n) as n from v),
q as (select *, mean1 - mean0 as estimate, (mean1 - mean0) / stderr as t_statistic from p)
select {r("mean0")} as mean0, {r("mean1")} as mean1, {r("estimate")} as estimate, {r("stderr")} as stderr, {r("t_statistic")} as t_statistic,
    {r(f"2 * (1 - {norm_cdf('abs(t_statistic)')})")} as p_value, {r(f"estimate - {t_quantile('n - 1')} * stderr")} as lower, {r(f"estimate + {t_quantile('n - 1')} * stderr")} as upper from q"""
)
def ttest_2samp_ratio(spark, sf):
    return rounded(hypothesis.ttest_2samp(table(spark, sf, "lineitem"), "avg(l_extendedprice) / avg(l_quantity)", "l_orderkey % 2"))


@query(
    f"""with {_RATIO.format(by="l_returnflag, ")},
p as (select l_returnflag, max(case when t = 0 then m end) as mean0, max(case when t = 1 then m end) as mean1, sqrt(sum(var)) as stderr from v group by 1)
select l_returnflag, {r("mean0")} as mean0, {r("mean1")} as mean1, {r("mean1 - mean0")} as estimate, {r("stderr")} as stderr, {r("(mean1 - mean0) / stderr")} as t_statistic from p"""
)
def ttest_2samp_grouped(spark, sf):
    out = hypothesis.ttest_2samp(table(spark, sf, "lineitem"), "avg(l_extendedprice) / avg(l_quantity)", "l_orderkey % 2", by=["l_returnflag"])
    return rounded(out).select("l_returnflag", "mean0", "mean1", "estimate", "stderr", "t_statistic")


_DELTA = "(vy / (mx * mx) - 2 * my * c / (mx * mx * mx) + my * my * vx / (mx * mx * mx * mx)) / n"
_ONE = "g as (select count(*) as n, avg(l_extendedprice) as my, avg(l_quantity) as mx, var_samp(l_extendedprice) as vy, var_samp(l_quantity) as vx, covar_samp(l_extendedprice, l_quantity) as c from lineitem)"


@query(f"with {_ONE} select {r(_DELTA, 3)} as variance from g")
def delta_method_variance(spark, sf):
    return rounded(hypothesis.delta_method(table(spark, sf, "lineitem"), "avg(l_extendedprice) / avg(l_quantity)"), 3)


@query(f"with {_ONE} select {r(f'sqrt({_DELTA})')} as std from g")
def delta_method_sql(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("effectum_lineitem")
    return rounded(sql(spark, "select deltamethod(avg(l_extendedprice) / avg(l_quantity), true) from effectum_lineitem"))


@query(
    f"""with {_ONE}, q as (select my / mx as estimate, sqrt({_DELTA}) as stderr, n from g), t as (select *, (estimate - 2000) / stderr as t_statistic from q)
select {r("estimate")} as estimate, {r("stderr")} as stderr, {r("t_statistic")} as t_statistic, {r(f"2 * (1 - {norm_cdf('abs(t_statistic)')})")} as p_value,
    {r(f"estimate - {t_quantile('n - 1')} * stderr")} as lower, {r(f"estimate + {t_quantile('n - 1')} * stderr")} as upper from t"""
)
def ttest_1samp_ratio(spark, sf):
    return rounded(hypothesis.ttest_1samp(table(spark, sf, "lineitem"), "avg(l_extendedprice) / avg(l_quantity)", mu=2000))


@query(
    f"""with g as (select {ARM} as t, count(*) as n, avg(l_extendedprice) as my, avg(l_quantity) as mx, var_samp(l_extendedprice) as vy, var_samp(l_quantity) as vx, covar_samp(l_extendedprice, l_quantity) as c from lineitem group by 1),
p as (select covar_samp(l_extendedprice, l_quantity) / var_samp(l_quantity) as theta, avg(l_quantity) as mx from lineitem),
a as (select t, g.my - theta * (g.mx - p.mx) as m, (vy + theta * theta * vx - 2 * theta * c) / n as var from g, p)
select {r("max(case when t = 0 then m end)")} as mean0, {r("max(case when t = 1 then m end)")} as mean1, {r("sqrt(sum(var))")} as stderr from a"""
)
def ttest_2samp_cuped(spark, sf):
    return rounded(hypothesis.ttest_2samp(table(spark, sf, "lineitem"), "avg(l_extendedprice)", "l_orderkey % 2", x="avg(l_quantity)")).select("mean0", "mean1", "stderr")


@query(
    f"""with g as (select l_returnflag as s, {ARM} as t, count(*) as n, avg(l_extendedprice) as m, var_samp(l_extendedprice) as v from lineitem group by 1, 2),
w as (select s, sum(n) * 1.0 / (select count(*) from lineitem) as share from g group by 1)
select {r("sum(case when t = 0 then share * m end)")} as mean0, {r("sum(case when t = 1 then share * m end)")} as mean1, {r("sqrt(sum(share * share * v / n))")} as stderr from g join w using (s)"""
)
def ttest_2samp_post_stratified(spark, sf):
    return rounded(hypothesis.ttest_2samp(table(spark, sf, "lineitem"), "avg(l_extendedprice)", "l_orderkey % 2", pse="l_returnflag")).select("mean0", "mean1", "stderr")


@query(
    f"""with g as (select l_returnflag as a, count(*) as n, avg(l_extendedprice) as m, var_samp(l_extendedprice) as v from lineitem group by 1)
select x.a as control, y.a as treatment, {r("x.m")} as mean0, {r("y.m")} as mean1, {r("y.m - x.m")} as estimate, {r("sqrt(x.v / x.n + y.v / y.n)")} as stderr from g x join g y on x.a < y.a"""
)
def ttests_2samp_pairs(spark, sf):
    return rounded(hypothesis.ttests_2samp(table(spark, sf, "lineitem"), "avg(l_extendedprice)", "l_returnflag")).select("control", "treatment", "mean0", "mean1", "estimate", "stderr")


_PAIR = f"""with g as (select {ARM} as t, count(*) as n, avg(l_extendedprice) as m, var_samp(l_extendedprice) as v from lineitem group by 1),
p as (select max(case when t = 0 then n end) as n0, max(case when t = 1 then n end) as n1, max(case when t = 0 then m end) as m0, max(case when t = 1 then m end) as m1, max(case when t = 0 then v end) as v0, max(case when t = 1 then v end) as v1 from g) """


@query(_PAIR + f"select {r('(m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1))')} as t_statistic from p")
def student_ttest(spark, sf):
    return rounded(hypothesis.student_ttest(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey % 2")).select("t_statistic")


@query(_PAIR + f"select {r('(m0 - m1) / sqrt(v0 / n0 + v1 / n1)')} as t_statistic from p")
def welch_ttest(spark, sf):
    return rounded(hypothesis.welch_ttest(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey % 2")).select("t_statistic")


@query(_PAIR + f", z as (select *, sqrt(5e8 / n0 + 6e8 / n1) as se from p) select {r('(m0 - m1) / se')} as z_statistic, {r('2 * ' + norm_cdf('-abs((m0 - m1) / se)'))} as p_value, {r(f'm0 - m1 - {Z!r} * se')} as lower, {r(f'm0 - m1 + {Z!r} * se')} as upper from z")
def mean_z_test(spark, sf):
    return rounded(hypothesis.mean_z_test(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey % 2", 5e8, 6e8))


@query()
def xexpt_ttest_2samp(spark, sf):
    return rounded(hypothesis.xexpt_ttest_2samp(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_orderkey % 2", "l_orderkey", x="avg(l_tax) / avg(l_quantity)"))


@query(
    f"""with g as (select {ARM} as t, sum(l_extendedprice) as n, sum(l_quantity) as d, count(*) as rows from lineitem group by 1)
select cast(t as varchar) as arm, {r("n", 2)} as numerator, {r("d", 2)} as denominator, cast(rows as bigint) as rows, {r("n / d")} as mean from g"""
)
def xexpt_arms(spark, sf):
    out = hypothesis.xexpt_ttest_2samp(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_orderkey % 2", "l_orderkey")
    return rounded(out, numerator=2, denominator=2).select("arm", "numerator", "denominator", "rows", "mean")


@query(
    f"""with g as (select {ARM} as t, count(*) * 1.0 as s from lineitem group by 1), e as (select *, sum(s) over () / 2 as f from g)
select cast(t as varchar) as groupname, s::double as f_obs, {r("f::double")} as f_exp, {r("sum((s - f) * (s - f) / f) over ()")} as chisquare, {r("2 * (1 - " + norm_cdf("sqrt(sum((s - f) * (s - f) / f) over ())") + ")")} as p_value from e"""
)
def srm(spark, sf):
    return rounded(hypothesis.srm(table(spark, sf, "lineitem"), "1", "l_orderkey % 2", [1, 1]))


_RANKS = f"""with v as (select l_extendedprice as v, {ARM} as t from lineitem), k as (select v, count(*) filter (where t = 0) as n0, count(*) filter (where t = 1) as n1, count(*)::double as n from v group by 1),
c as (select *, sum(n) over (order by v) as cum, sum(n0) over (order by v) as c0, sum(n1) over (order by v) as c1 from k) """


@query(
    _RANKS
    + f""", s as (select sum(n0)::double as n0, sum(n1)::double as n1, sum((cum - (n - 1) / 2) * n1) as r1, sum(n * n * n - n) as ties from c),
u as (select *, r1 - n1 * (n1 + 1) / 2 as u, sqrt(n0 * n1 * (n0 + n1 + 1) / 12 * (1 - ties / (pow(n0 + n1, 3) - (n0 + n1)))) as sd from s)
select u as u_statistic, {r("2 * " + norm_cdf("-greatest(abs(u - n0 * n1 / 2) - 0.5, 0) / sd"))} as p_value from u"""
)
def mann_whitney_utest(spark, sf):
    return rounded(hypothesis.mann_whitney_utest(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey % 2"))


@query(
    _RANKS
    + f""", d as (select max(abs(c0 / n0s - c1 / n1s)) as d, max(n0s) as n0, max(n1s) as n1 from (select *, sum(n0) over ()::double as n0s, sum(n1) over ()::double as n1s from c)),
s as (select d, sqrt(n0 * n1 / (n0 + n1)) * d as x from d)
select {r("d", 6)} as d_statistic, {r("least(1.0, greatest(0.0, 2 * (select sum(pow(-1, k - 1) * exp(-2 * k * k * x * x)) from (select unnest(range(1, 101)) as k))))")} as p_value from s"""
)
def kolmogorov_smirnov_test(spark, sf):
    """The limit law, which SQL can express; the exact one is in ``kolmogorov_smirnov_auto``."""
    return rounded(hypothesis.kolmogorov_smirnov_test(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey % 2", mode="asymp"), d_statistic=6)


@query()
def kolmogorov_smirnov_auto(spark, sf):
    return rounded(hypothesis.kolmogorov_smirnov_test(table(spark, sf, "customer"), "c_acctbal", "c_custkey % 2"), d_statistic=6)


@query(f"select {r('corr(l_extendedprice, l_quantity)', 6)} as r from lineitem")
def pearsonr(spark, sf):
    return rounded(hypothesis.pearsonr(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity"), 6).select("r")


# Regression

_TWO = """with m as (select count(*)::double as n, avg(l_quantity) as a, avg(l_discount) as b, avg(l_extendedprice) as y, covar_pop(l_quantity, l_quantity) as aa, covar_pop(l_discount, l_discount) as bb, covar_pop(l_quantity, l_discount) as ab,
    covar_pop(l_quantity, l_extendedprice) as ay, covar_pop(l_discount, l_extendedprice) as byy, covar_pop(l_extendedprice, l_extendedprice) as yy from lineitem),
s as (select *, aa * bb - ab * ab as det, (bb * ay - ab * byy) / (aa * bb - ab * ab) as b1, (aa * byy - ab * ay) / (aa * bb - ab * ab) as b2 from m),
e as (select *, n * (yy - b1 * ay - b2 * byy) / (n - 3) as s2, y - b1 * a - b2 * b as b0 from s) """


@query(
    _TWO
    + f"""select 'l_quantity' as term, {r("b1")} as estimate, {r("sqrt(s2 * bb / (n * det))")} as std_error, {r("1 - (n - 3) * s2 / (n * yy)", 6)} as r_squared from e union all
select 'l_discount', {r("b2", 3)}, {r("sqrt(s2 * aa / (n * det))", 3)}, {r("1 - (n - 3) * s2 / (n * yy)", 6)} from e union all
select 'intercept', {r("b0")}, {r("sqrt(s2 * (1 / n + (a * a * bb - 2 * a * b * ab + b * b * aa) / (n * det)))")}, {r("1 - (n - 3) * s2 / (n * yy)", 6)} from e"""
)
def ols(spark, sf):
    out = regression.ols(table(spark, sf, "lineitem"), "l_extendedprice ~ l_quantity + l_discount")
    three = lambda c: F.when(F.col("term") == "l_discount", F.round(c, 3)).otherwise(F.round(c, 4)) + F.lit(0.0)
    return out.select("term", three("estimate").alias("estimate"), three("std_error").alias("std_error"), (F.round("r_squared", 6) + F.lit(0.0)).alias("r_squared"))


@query(f"select l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)')} as slope, {r('regr_intercept(l_extendedprice, l_quantity)')} as intercept, {r('regr_r2(l_extendedprice, l_quantity)', 6)} as r_squared from lineitem group by 1")
def ols_grouped(spark, sf):
    out = regression.ols(table(spark, sf, "lineitem"), "l_extendedprice ~ l_quantity", by=["l_returnflag"])
    one = lambda t, c: F.max(F.when(F.col("term") == t, F.col(c)))
    wide = out.groupBy("l_returnflag").agg(one("l_quantity", "estimate").alias("slope"), one("intercept", "estimate").alias("intercept"), F.max("r_squared").alias("r_squared"))
    return rounded(wide, r_squared=6)


@query(f"select 'l_quantity' as term, {r('sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity)')} as estimate from lineitem")
def ols_no_intercept(spark, sf):
    return rounded(regression.ols(table(spark, sf, "lineitem"), "l_extendedprice ~ l_quantity - 1")).select("term", "estimate")


@query(
    f"""with m as (select sum(l_tax) as w, sum(l_tax * l_quantity) as x, sum(l_tax * l_extendedprice) as y, sum(l_tax * l_quantity * l_quantity) as xx, sum(l_tax * l_quantity * l_extendedprice) as xy from lineitem),
s as (select *, (xy - x * y / w) / (xx - x * x / w) as b from m)
select 'l_quantity' as term, {r("b")} as estimate from s union all select 'intercept', {r("(y - b * x) / w")} from s"""
)
def wls(spark, sf):
    return rounded(regression.wls(table(spark, sf, "lineitem"), "l_extendedprice ~ l_quantity", "l_tax")).select("term", "estimate")


@query(
    f"""with m as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, count(*)::double as n, avg(l_quantity) as mx, regr_sxx(l_extendedprice, l_quantity) as sxx,
    (regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) as s2 from lineitem)
select l_orderkey, l_linenumber, {r("a + b * l_quantity", 2)} as prediction, {r(f"a + b * l_quantity - {t_quantile('n - 2')} * sqrt(s2 * (1 / n + (l_quantity - mx) * (l_quantity - mx) / sxx))", 2)} as lower,
    {r(f"a + b * l_quantity + {t_quantile('n - 2')} * sqrt(s2 * (1 / n + (l_quantity - mx) * (l_quantity - mx) / sxx))", 2)} as upper from lineitem, m"""
)
def predict_interval(spark, sf):
    df = table(spark, sf, "lineitem")
    model = regression.fit_ols(df, "l_extendedprice ~ l_quantity")
    return rounded(df.select("l_orderkey", "l_linenumber", model.interval("confidence").alias("p")).select("l_orderkey", "l_linenumber", "p.*"), 2)


@query(
    f"""with g as (select {ARM} as a, cast(l_linenumber % 2 as int) as t, avg(l_extendedprice) as m from lineitem group by 1, 2)
select {r("sum(case when a = t then m else -m end)", 3)} as did from g"""
)
def did(spark, sf):
    out = regression.did(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey % 2", "l_linenumber % 2")
    return rounded(out.where(F.col("term").contains("*")).select(F.col("estimate").alias("did")), 3)


@query(f"select 'l_quantity' as term, {r('covar_pop(l_extendedprice, l_suppkey) / covar_pop(l_quantity, l_suppkey)', 2)} as estimate from lineitem")
def iv_regression(spark, sf):
    out = regression.iv_regression(table(spark, sf, "lineitem"), "l_extendedprice ~ (l_quantity ~ l_suppkey)")
    return rounded(out.where("term = 'l_quantity'").select("term", "estimate"), 2)


@query(f"select {r('sum(l_quantity * l_quantity)')} as a, {r('sum(l_quantity * l_discount)')} as b, {r('sum(l_discount * l_discount)')} as c from lineitem")
def matrix_multiplication(spark, sf):
    m = regression.matrix_multiplication(table(spark, sf, "lineitem"), "l_quantity", "l_discount")
    return spark.createDataFrame([(round(float(m[0, 0]), 4), round(float(m[0, 1]), 4), round(float(m[1, 1]), 4))], "a double, b double, c double")


def _binary(spark, sf):
    return table(spark, sf, "lineitem").withColumn("hit", (F.col("l_returnflag") == "R").cast("int"))


@query()
def logistic_irls(spark, sf):
    model = regression.Logistic(iterations=25).fit("hit", ["l_quantity", "l_discount"], _binary(spark, sf))
    return rounded(model.summary(spark.range(1)))


@query("with v as (select l_extendedprice as v, l_returnflag = 'R' as h from lineitem), r as (select h, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as k from v), s as (select sum(k) filter (where h) as r1, count(*) filter (where h)::double as p, count(*) filter (where not h)::double as q from r) select round((r1 - p * (p + 1) / 2) / (p * q), 8) + 0.0 as auc from s")
def auc_exact(spark, sf):
    return rounded(regression.auc(_binary(spark, sf), "hit", "l_extendedprice"), 8)


@query("with v as (select l_quantity as v, count(*) filter (where l_returnflag = 'R') as p, count(*) filter (where l_returnflag <> 'R') as q from lineitem group by 1) select v as threshold, round(sum(q) over (order by v desc)::double / sum(q) over (), 8) + 0.0 as fpr, round(sum(p) over (order by v desc)::double / sum(p) over (), 8) + 0.0 as tpr from v")
def roc_curve(spark, sf):
    return rounded(regression.roc_curve(_binary(spark, sf), "hit", "l_quantity"), 8)


@query()
def stochastic_linear_regression(spark, sf):
    df = table(spark, sf, "lineitem")
    return regression.StochasticLinearRegression().fit("l_extendedprice ~ l_quantity + l_discount", df).effect(df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))


@query()
def stochastic_logistic_regression(spark, sf):
    df = _binary(spark, sf)
    return regression.StochasticLogisticRegression().fit("hit ~ l_quantity + l_discount", df).effect(df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))


# Resampling


@query()
def boot_strap(spark, sf):
    return resampling.boot_strap(table(spark, sf, "lineitem"), "avg(l_extendedprice) / avg(l_quantity)", "concat(l_orderkey, '-', l_linenumber)")


@query()
def permutation(spark, sf):
    return resampling.permutation(table(spark, sf, "lineitem"), "avg(l_extendedprice)", "l_orderkey % 2", "concat(l_orderkey, '-', l_linenumber)")


@query()
def ate_estimator(spark, sf):
    return resampling.ate_estimator(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey % 2", "concat(l_orderkey, '-', l_linenumber)")


@query()
def ipw_estimator(spark, sf):
    return resampling.ipw_estimator(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey % 2", "0.5", "concat(l_orderkey, '-', l_linenumber)")


@query()
def quantile_test_bucket(spark, sf):
    return resampling.quantile_test_bucket(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey % 2", [0.25, 0.5, 0.75], "l_orderkey")


@query()
def boot_strap_multi(spark, sf):
    return resampling.boot_strap_multi(table(spark, sf, "lineitem"), ["avg(l_extendedprice)", "avg(l_extendedprice) / avg(l_quantity)"], "concat(l_orderkey, '-', l_linenumber)")


@query()
def boot_strap_ols(spark, sf):
    return resampling.boot_strap_ols(table(spark, sf, "lineitem"), "l_extendedprice ~ l_quantity", "concat(l_orderkey, '-', l_linenumber)")


@query()
def feature_pipeline(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
    return ml_features.feature_process(df, "l_orderkey", one_hot=True).select("l_orderkey", ml_features.vector_to_array("features").alias("features"))


@query()
def logistic_regression_ml(spark, sf):
    return ml_features.logistic_regression(_binary(spark, sf), "hit", ["l_quantity", "l_linestatus"], ["l_linestatus"])


@query("select count(*) as rows from lineitem")
def partition_row_counts(spark, sf):
    return ml_features.partition_row_counts(table(spark, sf, "lineitem")).agg(F.sum("rows").alias("rows"))


# Uplift


@query(
    f"""with v as (select o_orderkey as ite, o_totalprice as y, cast(o_custkey % 2 as int)::double as t from orders), o as (select *, row_number() over (order by ite desc) as rn, count(*) over () as n from v),
b as (select *, case when rn <= (20 - n % 20) * (n // 20) then ceil(rn * 1.0 / (n // 20)) else 20 - n % 20 + ceil((rn - (20 - n % 20) * (n // 20)) * 1.0 / (n // 20 + 1)) end as bucket from o),
g as (select bucket, count(*)::double as c, sum(t) as t, sum(y) as y, sum(t * y) as ty, max(n) as n from b group by 1),
c as (select bucket, n, sum(c) over w as c, sum(t) over w as t, sum(y) over w as y, sum(ty) over w as ty from g window w as (order by bucket))
select cast(bucket as bigint) as bucket, {r("c / n", 6)} as ratio, {r("ty / t - (y - ty) / (c - t)", 3)} as lift, {r("c / n * (ty / t - (y - ty) / (c - t))", 3)} as gain from c"""
)
def lift_gain(spark, sf):
    out = uplift.get_lift_gain(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", "o_custkey % 2", K=20, normalize=False)
    return rounded(out.select("bucket", "ratio", "lift", "gain"), 3, ratio=6)


_KEY = "concat(l_orderkey, '-', l_linenumber)"


@query()
def linear_dml(spark, sf):
    df = table(spark, sf, "lineitem")
    return regression.summary(df, uplift.LinearDML(_KEY, cv=3).fit(df, "l_extendedprice", "l_discount", ["l_tax"], ["l_quantity"]).model)


@query()
def nonparam_dml(spark, sf):
    df = table(spark, sf, "lineitem")
    return regression.summary(df, uplift.NonParamDML(_KEY).fit(df, "l_extendedprice", "l_discount", ["l_tax"], ["l_quantity"]).model)


@query()
def causal_tree(spark, sf):
    df = table(spark, sf, "lineitem")
    return uplift.CausalTree(_KEY, depth=3, min_arm=20).fit("l_extendedprice", "l_orderkey % 2", ["l_quantity", "l_discount"], df).rules(df)


@query()
def causal_forest(spark, sf):
    df = table(spark, sf, "lineitem")
    forest = uplift.CausalForest(_KEY, mtry=2).fit("l_extendedprice", "l_orderkey % 2", ["l_quantity", "l_discount"], df)
    return forest.effect(df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))


@query("select 'l_quantity' as col, cast(l_orderkey % 2 as int) as treatment, l_quantity as value, count(*) as cnt, round(sum(l_extendedprice), 2) + 0.0 as sum, round(sum(l_extendedprice * l_extendedprice) / 1000, 2) + 0.0 as sum2 from lineitem group by all union all select 'l_linenumber', cast(l_orderkey % 2 as int), l_linenumber::double, count(*), round(sum(l_extendedprice), 2) + 0.0, round(sum(l_extendedprice * l_extendedprice) / 1000, 2) + 0.0 from lineitem group by all")
def group_set(spark, sf):
    out = uplift.group_set(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"], "l_extendedprice", "l_orderkey % 2")
    return rounded(out.withColumn("sum2", F.col("sum2") / 1000), 2, value=6)


@query()
def simulate_randomized_trial(spark, sf):
    """Made-up rows; no other query runs over them."""
    return uplift.simulate_randomized_trial(spark, n=4000, p=3, add_cost_benefit=True)


def _trial(spark, sf):
    """All line items as a trial: the arm is the order's parity; three covariates, an outcome, a binary outcome, revenue and cost."""
    named = {"x0": "l_discount", "x1": "l_tax", "x2": "l_quantity", "treatment": "cast(l_orderkey % 2 as int)", "outcome": "l_extendedprice", "hit": "cast(l_returnflag = 'R' as double)", "revenue": "l_extendedprice", "cost": "l_quantity"}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_KEY).alias("unit"), *[F.expr(e).alias(c) for c, e in named.items()])


def _learner(kind, name):
    @query(name=name)
    def run(spark, sf):
        df = _trial(spark, sf)
        y = "hit" if kind in (uplift.ClassVariableTransformation, uplift.Retrospective) else "outcome"
        return kind(y, "treatment", ["x0", "x1", "x2"]).fit(df).predict(df).select("l_orderkey", "l_linenumber", "cate_outcome")

    return run


for _kind, _name in ((uplift.SLearner, "s_learner"), (uplift.TLearner, "t_learner"), (uplift.XLearner, "x_learner"), (uplift.ClassVariableTransformation, "class_variable_transformation"), (uplift.TransformedOutcome, "transformed_outcome"), (uplift.Propensity, "propensity"), (uplift.Retrospective, "retrospective")):
    _learner(_kind, _name)


@query(f"select {r('avg(l_extendedprice) filter (where l_orderkey % 2 = 1) - avg(l_extendedprice) filter (where l_orderkey % 2 = 0)')} as ate, count(*) filter (where l_orderkey % 2 = 1)::double as n_treated, count(*) filter (where l_orderkey % 2 = 0)::double as n_control from lineitem")
def estimate_ate(spark, sf):
    return rounded(uplift.estimate(table(spark, sf, "lineitem"), "ate", target="l_extendedprice", treatment="cast(l_orderkey % 2 as int)"))


@query(f"select cast(l_linenumber as bigint) as bucket, {r('avg(l_extendedprice) filter (where l_orderkey % 2 = 1) - avg(l_extendedprice) filter (where l_orderkey % 2 = 0)')} as ate from lineitem group by 1")
def estimate_cate_per_bucket(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("bucket", F.col("l_linenumber").cast("long"))
    return rounded(uplift.estimate(df, "ate", target="l_extendedprice", treatment="cast(l_orderkey % 2 as int)", bucket="bucket")).select("bucket", "ate")


@query(f"select {r('sum(l_extendedprice) / sum(l_quantity)')} as roi from lineitem")
def estimate_roi(spark, sf):
    return rounded(uplift.estimate(table(spark, sf, "lineitem"), "roi", benefit="l_extendedprice", cost="l_quantity", treatment="cast(l_orderkey % 2 as int)")).select("roi")


@query(f"with g as (select l_orderkey % 2 as t, avg(l_extendedprice) as b, avg(l_quantity) as c from lineitem group by 1) select {r('(max(b) filter (where t = 1) - max(b) filter (where t = 0)) / (max(c) filter (where t = 1) - max(c) filter (where t = 0))', 2)} as iroi from g")
def estimate_iroi(spark, sf):
    return rounded(uplift.estimate(table(spark, sf, "lineitem"), "iroi", benefit="l_extendedprice", cost="l_quantity", treatment="cast(l_orderkey % 2 as int)"), 2).select("iroi")


@query(f"select cast(l_linenumber as bigint) as bucket, {r('avg(l_extendedprice)')} as target_rate from lineitem group by 1")
def estimate_target_rate_per_bucket(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("bucket", F.col("l_linenumber").cast("long"))
    return rounded(uplift.estimate(df, "target_rate", target="l_extendedprice", treatment="cast(l_orderkey % 2 as int)", bucket="bucket")).select("bucket", "target_rate")


@query()
def estimate_ate_bootstrap(spark, sf):
    return uplift.estimate(_trial(spark, sf), "ate", n_bootstraps=40, key="unit")


@query()
def estimate_cate_per_quantile(spark, sf):
    return uplift.estimate_per_quantile(_trial(spark, sf), "ate", score="x0", n_buckets=10)


@query()
def estimate_target_rate_per_quantile(spark, sf):
    return uplift.estimate_per_quantile(_trial(spark, sf), "target_rate", score="x0", n_buckets=10)


@query()
def estimate_iroi_per_quantile(spark, sf):
    return uplift.estimate_per_quantile(_trial(spark, sf), "iroi", score="x0", n_buckets=10)


@query()
def estimate_cate_lift(spark, sf):
    return uplift.estimate_cate_lift(_trial(spark, sf), score="x0", n_buckets=10)


@query()
def estimate_qini(spark, sf):
    return uplift.estimate_qini(_trial(spark, sf), score="x0", n_buckets=10)


@query()
def estimate_cum_iroi(spark, sf):
    return uplift.estimate(uplift.assign_bucket(_trial(spark, sf), "x0", 10), "iroi", bucket="bucket", cumulative=True)


# Matching and features

_MATCH = """with b as (select {id}, {t} as t, {cell} as k from {table}), s as (select k, count(*) filter (where t = 1) as n1, count(*) filter (where t = 0) as n0 from b group by 1 having count(*) filter (where t = 1) > 0 and count(*) filter (where t = 0) > 0),
o as (select k, least(n1, n0) as q, coalesce(sum(least(n1, n0)) over (order by k rows between unbounded preceding and 1 preceding), 0) as o from s),
n as (select b.*, row_number() over (partition by k, t order by {id}) as rn from b)
select {id}, cast(case when o.k is not null and rn <= q then case when t = 1 then o + rn else -(o + rn) end else 0 end as bigint) as matching_index from n left join o using (k)"""


@query(_MATCH.format(id="o_orderkey", t="cast(o_custkey % 2 as int)", cell="floor(o_totalprice / 500.0)", table="orders"))
def caliper_matching(spark, sf):
    return matching.caliper_matching(table(spark, sf, "orders"), "o_custkey % 2", "o_totalprice", 500.0, order=["o_orderkey"]).select("o_orderkey", "matching_index")


@query(_MATCH.format(id="o_orderkey", t="cast(o_custkey % 2 as int)", cell="o_orderpriority", table="orders"))
def exact_matching(spark, sf):
    return matching.exact_matching(table(spark, sf, "orders"), "o_custkey % 2", ["o_orderpriority"], order=["o_orderkey"]).select("o_orderkey", "matching_index")


def _smd(c: str) -> str:
    one, zero = f"case when l_orderkey % 2 = 1 then {c} end", f"case when l_orderkey % 2 = 0 then {c} end"
    return f"select '{c}' as covariate, {r(f'avg({zero})', 6)} as mean0, {r(f'avg({one})', 6)} as mean1, {r(f'(avg({one}) - avg({zero})) / sqrt((var_samp({zero}) + var_samp({one})) / 2)', 6)} as smd from lineitem"


@query(" union all ".join(map(_smd, ("l_quantity", "l_discount", "l_tax"))))
def smd(spark, sf):
    return rounded(matching.smd(table(spark, sf, "lineitem"), "l_orderkey % 2", ["l_quantity", "l_discount", "l_tax"]), 6)


@query()
def prognostic_score_matching(spark, sf):
    df = table(spark, sf, "lineitem")
    return matching.PrognosticScoreMatching("l_orderkey % 2", "l_extendedprice", ["l_quantity"]).fit(df).match(df, caliper=500.0, order=["l_orderkey", "l_linenumber", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "matching_index")


@query("select o_orderkey, case when o_totalprice < 1000 then '<1000' when o_totalprice < 50000 then '[1000,50000)' else '>=50000' end as bin from orders")
def cut_bins(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", features.cut_bins("o_totalprice", [1000, 50000]).alias("bin"))


@query("with q as (select quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) as q from orders) select o_orderkey, cast(case when o_totalprice < q[1] then 1 when o_totalprice < q[2] then 2 when o_totalprice < q[3] then 3 else 4 end as int) as b from orders, q")
def bucketizer(spark, sf):
    return features.Bucketizer(["o_totalprice"], quantiles=[0.25, 0.5, 0.75], output_cols=["b"], if_string=False).fit(table(spark, sf, "orders")).select("o_orderkey", "b")


@query("select c_custkey, " + ", ".join(f"cast(c_mktsegment = '{s}' as int) as \"c_mktsegment_{s}\"" for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from customer")
def one_hot_encoder(spark, sf):
    return features.OneHotEncoder().fit(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"]).drop("c_mktsegment")


@query(" union all ".join(f"select '{c}' as \"column\", count({c}) as \"count\", {r(f'avg({c})')} as avg, {r(f'stddev_samp({c})')} as std, min({c})::double as min, max({c})::double as max from lineitem" for c in ("l_quantity", "l_discount", "l_extendedprice")))
def describe(spark, sf):
    return rounded(features.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]).select("column", "count", "avg", "std", "min", "max"))


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b})', 6)} as corr from lineitem" for i, a in enumerate(("l_quantity", "l_discount", "l_tax")) for b in ("l_quantity", "l_discount", "l_tax")[i:]))
def correlation_matrix(spark, sf):
    return rounded(features.correlation_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), 6)


@query("select l_returnflag as value, count(*) as n from lineitem group by 1")
def histogram(spark, sf):
    return features.histogram(table(spark, sf, "lineitem"), "l_returnflag")


@query("with q as (select quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) as q from lineitem) select round(q[1], 4) + 0.0 as minimum, round(q[2], 4) + 0.0 as q1, round(q[3], 4) + 0.0 as median, round(q[4], 4) + 0.0 as q3, round(q[5], 4) + 0.0 as maximum from q")
def five_numbers(spark, sf):
    return rounded(features.five_numbers(table(spark, sf, "lineitem"), "l_extendedprice").select("minimum", "q1", "median", "q3", "maximum"))


@query("with p as (select l_quantity as time, count(*) as n, count(*) filter (where l_returnflag = 'R') as events from lineitem group by 1), c as (select *, sum(n) over (order by time desc) as at_risk from p) select time, cast(at_risk as bigint) as at_risk, events, round(exp(sum(ln(1 - events / at_risk)) over (order by time)), 8) + 0.0 as survival from c")
def kaplan_meier(spark, sf):
    return rounded(features.kaplan_meier(table(spark, sf, "lineitem"), "l_quantity", "cast(l_returnflag = 'R' as int)"), 8)


@query()
def long_term(spark, sf):
    return features.LongTerm("l_orderkey", "l_linenumber", "l_orderkey % 2", ["l_extendedprice", "l_quantity"], (1, 2), [3, 4]).fit(table(spark, sf, "lineitem")).get_results()


@query("select event_id, coalesce(event_type, '-1') as event_type, coalesce(value, 0) as value from events")
def preprocess_na(spark, sf):
    return features.preprocess_na(table(spark, sf, "events").select("event_id", "event_type", "value"))


# Functions

_NUM = "l_extendedprice"
_SCALAR = {
    "sqrt": (lambda: F.sqrt(_NUM), f"sqrt({_NUM})"),
    "floor": (lambda: F.floor(_NUM).cast("double"), f"floor({_NUM})"),
    "ceil": (lambda: F.ceil(_NUM).cast("double"), f"ceil({_NUM})"),
    "abs": (lambda: F.abs(F.col(_NUM) - 3e4), f"abs({_NUM} - 3e4)"),
    "pow": (lambda: F.pow("l_discount", F.lit(1.5)), "pow(l_discount, 1.5)"),
    "exp": (lambda: F.exp("l_discount"), "exp(l_discount)"),
    "ln": (lambda: F.log(_NUM), f"ln({_NUM})"),
    "log2": (lambda: F.log2(_NUM), f"log2({_NUM})"),
    "log10": (lambda: F.log10(_NUM), f"log10({_NUM})"),
    "exp2": (lambda: scalar.exp2("l_discount"), "pow(2, l_discount)"),
    "exp10": (lambda: scalar.exp10("l_discount"), "pow(10, l_discount)"),
    "int_exp2": (lambda: scalar.int_exp2("l_linenumber").cast("double"), "pow(2, l_linenumber)"),
    "int_exp10": (lambda: scalar.int_exp10("l_linenumber").cast("double"), "pow(10, l_linenumber)"),
    "cbrt": (lambda: F.cbrt(_NUM), f"cbrt({_NUM})"),
    "lgamma": (lambda: scalar.lgamma("l_quantity"), "lgamma(l_quantity)"),
    "tgamma": (lambda: scalar.tgamma(F.col("l_discount") + 1), "gamma(l_discount + 1)"),
    "sin": (lambda: F.sin("l_quantity"), "sin(l_quantity)"),
    "cos": (lambda: F.cos("l_quantity"), "cos(l_quantity)"),
    "tan": (lambda: F.tan("l_discount"), "tan(l_discount)"),
    "asin": (lambda: F.asin("l_discount"), "asin(l_discount)"),
    "acos": (lambda: F.acos("l_discount"), "acos(l_discount)"),
    "atan": (lambda: F.atan("l_quantity"), "atan(l_quantity)"),
    "gcd": (lambda: scalar.gcd("l_partkey", "l_suppkey").cast("double"), "gcd(l_partkey, l_suppkey)"),
    "lcm": (lambda: scalar.lcm("l_partkey", "l_suppkey").cast("double"), "lcm(l_partkey, l_suppkey)"),
    "mod": (lambda: scalar.modulo("l_partkey", F.lit(7)).cast("double"), "l_partkey % 7"),
    "divide": (lambda: scalar.divide(_NUM, "l_quantity"), f"{_NUM} / nullif(l_quantity, 0)"),
    "greatest": (lambda: scalar.maximum("l_quantity", "l_suppkey"), "greatest(l_quantity, l_suppkey)"),
    "least": (lambda: scalar.minimum("l_quantity", "l_suppkey"), "least(l_quantity, l_suppkey)"),
    "round_even": (lambda: scalar.round_half_even(F.col("l_quantity") / 2), "round_even(l_quantity / 2, 0)"),
    "cdf": (lambda: scalar.cdf(F.col("l_quantity") / 10 - 2.5), norm_cdf("(l_quantity / 10 - 2.5)")),
    "if_else": (lambda: F.when(F.col("l_tax") > 0.04, 1.0).otherwise(-1.0), "case when l_tax > 0.04 then 1.0 else -1.0 end"),
    "e": (lambda: F.e(), "exp(1)"),
    "pi": (lambda: F.pi(), "pi()"),
}


@query("select l_orderkey, l_linenumber, " + ", ".join(f"round(({s})::double, 9) + 0.0 as f_{n}" for n, (_, s) in _SCALAR.items()) + " from lineitem")
def scalar_functions(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[(F.round(f().cast("double"), 9) + F.lit(0.0)).alias(f"f_{n}") for n, (f, _) in _SCALAR.items()])


@query("select l_orderkey, l_linenumber, l_quantity < 10 as lt, l_quantity <= 10 as le, l_quantity > 10 as gt, l_quantity >= 10 as ge, l_quantity = 10 as eq, l_quantity <> 10 as ne, l_tax is null as isnull, l_tax is not null as isnotnull, l_quantity + 1 as plus, l_quantity - 1 as minus, l_quantity * 2 as times, -l_quantity as negative from lineitem")
def operators(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (q < 10).alias("lt"), (q <= 10).alias("le"), (q > 10).alias("gt"), (q >= 10).alias("ge"), (q == 10).alias("eq"), (q != 10).alias("ne"), F.isnull("l_tax").alias("isnull"), F.isnotnull("l_tax").alias("isnotnull"), (q + 1).alias("plus"), (q - 1).alias("minus"), (q * 2).alias("times"), (-q).alias("negative"))


_AGG = "round(stddev_pop(l_quantity), 6) + 0.0 as stddev_pop, round(stddev_samp(l_quantity), 6) + 0.0 as stddev_samp, round(var_pop(l_quantity), 6) + 0.0 as var_pop, round(var_samp(l_quantity), 6) + 0.0 as var_samp, round(covar_pop(l_quantity, l_tax), 6) + 0.0 as covar_pop, round(covar_samp(l_quantity, l_tax), 6) + 0.0 as covar_samp, round(corr(l_quantity, l_tax), 6) + 0.0 as corr, count(*) as n, max(l_quantity) as max, min(l_quantity) as min, round(avg(l_quantity), 6) + 0.0 as avg, round(sum(l_quantity), 2) + 0.0 as sum, quantile_disc(l_quantity, 0.25) as q25, max_by(l_quantity, l_extendedprice) as any_max, min_by(l_quantity, l_extendedprice) as any_min"


@query(f"select l_returnflag, {_AGG} from lineitem group by 1")
def aggregates(spark, sf):
    f = Frame(placed(spark, sf, "lineitem")).groupBy("l_returnflag")
    q = "l_quantity"
    out = f.agg(F.stddev_pop(q).alias("stddev_pop"), F.stddev_samp(q).alias("stddev_samp"), F.var_pop(q).alias("var_pop"), F.var_samp(q).alias("var_samp"), F.covar_pop(q, "l_tax").alias("covar_pop"), F.covar_samp(q, "l_tax").alias("covar_samp"), F.corr(q, "l_tax").alias("corr"), F.count("*").alias("n"), scalar.maximum(q).alias("max"), scalar.minimum(q).alias("min"), F.avg(q).alias("avg"), F.sum(q).alias("sum"), scalar.quantile(q, 0.25, True).alias("q25"), scalar.any_max(q, "l_extendedprice", "__row").alias("any_max"), scalar.any_min(q, "l_extendedprice", "__row").alias("any_min"))
    return rounded(out.df, 6, sum=2)


_VEC = "list_transform(embedding, lambda x: x::double)"


@query(
    f"""with p as (select a.vec_id, {_VEC.replace("embedding", "a.embedding")} as x, {_VEC.replace("embedding", "b.embedding")} as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select vec_id, {r("list_sum(list_transform(x, lambda v: abs(v)))", 5)} as l1, {r("sqrt(list_sum(list_transform(x, lambda v: v * v)))", 5)} as l2, {r("list_max(list_transform(x, lambda v: abs(v)))", 5)} as linf, {r("pow(list_sum(list_transform(x, lambda v: pow(abs(v), 3))), 1 / 3.0)", 5)} as lp,
    {r("list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))", 5)} as d1, {r("sqrt(list_sum(list_transform(list_zip(x, y), lambda z: pow(z[1] - z[2], 2))))", 5)} as d2, {r("list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))", 5)} as dinf, {r("list_cosine_similarity(x, y)", 5)} as cosine from p"""
)
def vector_functions(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    s = scalar
    return rounded(p.select("vec_id", s.l1_norm("x").alias("l1"), s.l2_norm("x").alias("l2"), s.linf_norm("x").alias("linf"), s.lp_norm("x", 3).alias("lp"), s.l1_distance("x", "y").alias("d1"), s.l2_distance("x", "y").alias("d2"), s.linf_distance("x", "y").alias("dinf"), s.cosine_similarity("x", "y").alias("cosine")), 5)


@query()
def murmur_hashes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalar.murmur_hash3_32("c_name").alias("h32"), scalar.murmur_hash3_64("c_name").alias("h64"))


# Frame

_JOIN = "from orders o {how} join (select * from customer where c_acctbal > 0) c on o.o_custkey = c.c_custkey"


def _joined(how):
    def run(spark, sf):
        o = Frame(table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
        c = Frame(table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name"))
        return o.join(c, "lhs.o_custkey = rhs.c_custkey", type=how).df

    return run


for _how in ("inner", "left", "right", "full", "semi", "anti"):
    query(f"select o_orderkey, o_custkey{', c_custkey, c_name' if _how not in ('semi', 'anti') else ''} {_JOIN.format(how=_how)}", f"join_{_how}")(_joined(_how))


@query("select n_name, r_name from nation, region")
def join_cross(spark, sf):
    return Frame(table(spark, sf, "nation").select("n_name")).join(Frame(table(spark, sf, "region").select("r_name")), type="cross").df


@query("select l_returnflag, sum(l_quantity) as q from lineitem where l_tax > 0.02 group by 1 having sum(l_quantity) > 100")
def filter_group_having(spark, sf):
    return Frame(table(spark, sf, "lineitem")).where("l_tax > 0.02").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q")).where("q > 100").df


@query("select l_orderkey, l_quantity * 2 as q2 from lineitem union all select o_orderkey, o_totalprice from orders")
def union_all(spark, sf):
    a = Frame(table(spark, sf, "lineitem")).withColumn("q2", "l_quantity * 2").select("l_orderkey", "q2")
    b = Frame(table(spark, sf, "orders")).select("o_orderkey", "o_totalprice").withColumnRenamed("o_orderkey", "l_orderkey").withColumnRenamed("o_totalprice", "q2")
    return a.union(b).df


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def order_limit(spark, sf):
    return Frame(table(spark, sf, "orders")).orderBy(F.col("o_totalprice").desc(), "o_orderkey").head(10).select("o_orderkey", "o_totalprice").df


@query()
def sample_and_split(spark, sf):
    train, test = Frame(table(spark, sf, "orders")).sample(0.5, seed=1).split(0.3, seed=2)
    return train.select("o_orderkey", "1 as train").union(test.select("o_orderkey", "0 as train")).df


# Streaming


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) + 0.0 as total from events group by all")
def tumbling_windows(spark, sf):
    out = windows.windowed(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")], "1 hour")
    return rounded(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total"))


@query("with w as (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as window_start, event_type from events) select window_start, event_type, count(*) as n from w group by all")
def sliding_windows(spark, sf):
    out = windows.windowed(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], [F.count("*").alias("n")], "1 hour", "30 minutes")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from l) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, s")
def session_windows(spark, sf):
    out = windows.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], [F.count("*").alias("n")], "30 minutes")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# Plain SQL

for _name, (_spark, _duck) in relational.QUERIES.items():

    def _plain(spark, sf, text=_spark):
        for t in TABLES:
            if t in text:
                table(spark, sf, t).createOrReplaceTempView(t)
        return sql(spark, text)

    query(_duck, _name)(_plain)

