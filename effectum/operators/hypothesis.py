"""Hypothesis tests for experiments: each is one aggregation and closed-form mathematics.

p-values of mean tests are from the normal law and confidence intervals from Student's t law with n - 1 degrees of
freedom, n the rows of all samples; that mixture is part of the semantics. A zero standard error gives
t = +-inf, or 0 where the estimate is about 0 too. An empty sample gives null statistics.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf, kolmogorov_sf, norm_cdf, norm_ppf, t_cdf, t_ppf
from .moments import MeanFunction, Moments, expr_of, finish, grouped, moment_columns, moments_of
from .ranges import running

ALTERNATIVES = ("two-sided", "less", "greater")
ONE = "estimate double,stderr double,t_statistic double,p_value double,lower double,upper double"
TWO = "mean0 double,mean1 double," + ONE


def judge(estimate: float, stderr: float, df: float, alternative: str, alpha: float = 0.05, null: float = 0.0) -> tuple:
    """estimate, stderr, t, p, lower and upper bound."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}")
    if math.isnan(estimate) or math.isnan(stderr):
        return (None,) * 6
    gap = estimate - null
    t = gap / stderr if stderr > 0 else 0.0 if abs(gap) < 1e-12 else math.copysign(math.inf, gap)
    if alternative == "two-sided":
        q = t_ppf(1 - alpha / 2, df)
        return estimate, stderr, t, 2 * (1 - norm_cdf(abs(t))), estimate - q * stderr, estimate + q * stderr
    q = t_ppf(1 - alpha, df)
    if alternative == "less":
        return estimate, stderr, t, norm_cdf(t), -math.inf, estimate + q * stderr
    return estimate, stderr, t, 1 - norm_cdf(t), estimate - q * stderr, math.inf


class Metric:
    """A function of means, with covariates (functions of means, joined by +) that reduce its variance."""

    def __init__(self, text: str, covariates: str = ""):
        self.value = MeanFunction(text)
        self.covariates = [MeanFunction(x) for x in _terms(covariates)]
        self.args: list[str] = []
        for f in (self.value, *self.covariates):
            self.args += [a for a in f.args if a not in self.args]

    def columns(self) -> list[Column]:
        return [expr_of(a) for a in self.args]

    def at(self, m: Moments) -> tuple[np.ndarray, np.ndarray]:
        """Values of metric and covariates, and their covariance matrix, by the delta method."""
        duals, rows = [], []
        for f in (self.value, *self.covariates):
            idx = [self.args.index(a) for a in f.args]
            d = f(m.mean[idx])
            g = np.zeros(len(self.args))
            g[idx] = d.grad
            duals.append(d.value)
            rows.append(g)
        g = np.array(rows)
        return np.array(duals), g @ m.sample_cov() @ g.T / m.n

    def theta(self, pooled: Moments) -> tuple[np.ndarray, np.ndarray]:
        """The regression of metric on covariates in the pooled sample, and the covariates' values there."""
        v, c = self.at(pooled)
        k = len(self.covariates)
        return (np.linalg.pinv(c[1:, 1:]) @ c[0, 1:] if k else np.zeros(0)), v[1:]


def _terms(text: str) -> list[str]:
    """Terms between + that stand outside parentheses."""
    out, depth, word = [], 0, ""
    for c in text or "":
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "+" and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return [w.strip() for w in [*out, word] if w.strip()]


def adjusted(metric: Metric, m: Moments, theta: np.ndarray, centre: np.ndarray) -> tuple[float, float]:
    """A group's metric and its variance after the covariates' share is taken out."""
    v, c = metric.at(m)
    value = v[0] - theta @ (v[1:] - centre)
    return float(value), float(c[0, 0] + theta @ c[1:, 1:] @ theta - 2 * theta @ c[0, 1:])


def delta_method(df: DataFrame, expression: str, *, std: bool = False, by: list[str] = ()) -> DataFrame:
    """The variance (or standard deviation) of a function of means."""
    f = MeanFunction(expression)

    def one(row):
        m = moments_of(row, len(f.args))
        if m.n < 1:
            return [(None,)]
        g = f(m.mean).grad
        v = float(g @ m.sample_cov() @ g / m.n)
        return [(math.sqrt(v) if std else v,)]

    return finish(grouped(df, f.columns(), [F.col(c) for c in by]), one, "std double" if std else "variance double", list(by))


def ttest_1samp(df: DataFrame, y: str, *, alternative: str = "two-sided", mu: float = 0.0, x: str = "", by: list[str] = ()) -> DataFrame:
    """A one-sample test of a function of means; covariates reduce its variance but don't move it."""
    metric = Metric(y, x)

    def one(row):
        m = moments_of(row, len(metric.args))
        if m.n < 2:
            return [(None,) * 6]
        theta, centre = metric.theta(m)
        value, variance = adjusted(metric, m, theta, centre)
        return [judge(value, math.sqrt(max(variance, 0)), m.n - 1, alternative, null=mu)]

    return finish(grouped(df, metric.columns(), [F.col(c) for c in by]), one, ONE, list(by))


def _by_arm(df: DataFrame, values: list[Column], index: str | Column, by: list[str], stratum: str | None = None) -> DataFrame:
    """One row for each of ``by`` with the moments of every arm (and stratum), as a list.

    Rows are first reduced to a row for each arm, so only those few are gathered.
    """
    arm = (F.expr(index) if isinstance(index, str) else index).cast("string").alias("arm")
    keys = [*[F.col(c) for c in by], arm, *([F.expr(stratum).cast("string").alias("stratum")] if stratum else [])]
    stats = df.groupBy(*keys).agg(*moment_columns(values)).where("arm is not null")
    return stats.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in stats.columns if c not in by])).alias("arms"))


def _arms(row, k: int) -> list[tuple[str, str | None, Moments]]:
    return sorted(((_label(a["arm"]), a["stratum"] if "stratum" in a else None, moments_of(a, k)) for a in row["arms"] if a["n"]), key=lambda x: (str(x[0]), str(x[1])))


def _label(arm: str) -> str:
    """0 and 1 however they are written: as number, decimal or truth value."""
    low = arm.lower()
    if low in ("true", "false"):
        return str(int(low == "true"))
    try:
        return str(int(x)) if (x := float(arm)).is_integer() else arm
    except ValueError:
        return arm


def ttest_2samp(df: DataFrame, y: str, index: str, *, alternative: str = "two-sided", x: str = "", pse: str = "", by: list[str] = ()) -> DataFrame:
    """Arm 1 against arm 0: unpooled variances, covariate adjustment with the pooled sample's slope, or post-stratification.

    ``pse`` is an expression whose values are the strata: their differences are weighted by their shares of all rows; a stratum without
    two rows in both arms is left out. Covariates are used within strata too.
    """
    metric = Metric(y, x)

    def one(row):
        arms = _arms(row, len(metric.args))
        strata: dict = {}
        for arm, s, m in arms:
            if arm in ("0", "1"):
                strata.setdefault(s, {})[arm] = m
        usable = {s: a for s, a in strata.items() if len(a) == 2 and min(m.n for m in a.values()) >= 2}
        if not usable:
            return [(None,) * 8]
        pooled = Moments.merge([m for a in usable.values() for m in a.values()])
        theta, centre = metric.theta(pooled)
        total = sum(m.n for a in usable.values() for m in a.values())
        means, variance = [0.0, 0.0], 0.0
        for a in usable.values():
            share = sum(m.n for m in a.values()) / total
            for i in (0, 1):
                value, v = adjusted(metric, a[str(i)], theta, centre)
                means[i] += share * value
                variance += share**2 * v
        return [(*means, *judge(means[1] - means[0], math.sqrt(max(variance, 0)), total - 1, alternative))]

    return finish(_by_arm(df, metric.columns(), index, list(by), pse or None), one, TWO, list(by))


def ttests_2samp(df: DataFrame, y: str, index: str, *, alternative: str = "two-sided", x: str = "", by: list[str] = ()) -> DataFrame:
    """All pairs of arms; in both directions where the test is one-sided. At most 20,000 arms."""
    metric = Metric(y, x)

    def one(row):
        arms = _arms(row, len(metric.args))
        if len(arms) > 20_000:
            raise ValueError("more than 20,000 groups")
        out = []
        for i, (a, _, m0) in enumerate(arms):
            for j, (b, _, m1) in enumerate(arms):
                if i == j or (alternative == "two-sided" and j < i) or min(m0.n, m1.n) < 2:
                    continue
                theta, centre = metric.theta(Moments.merge([m0, m1]))
                (v0, s0), (v1, s1) = adjusted(metric, m0, theta, centre), adjusted(metric, m1, theta, centre)
                out.append((a, b, v0, v1, *judge(v1 - v0, math.sqrt(max(s0 + s1, 0)), m0.n + m1.n - 1, alternative)))
        return out

    return finish(_by_arm(df, metric.columns(), index, list(by)), one, "control string,treatment string," + TWO, list(by))


def _two_arms(df: DataFrame, value: str, index: str, by: list[str], function, schema: str) -> DataFrame:
    def one(row):
        found = {arm: m for arm, _, m in _arms(row, 1)}
        return [function(found["0"], found["1"])] if {"0", "1"} <= found.keys() and min(found["0"].n, found["1"].n) > 1 else [(None,) * len(schema.split(","))]

    return finish(_by_arm(df, [expr_of(value)], index, by), one, schema, by)


def student_ttest(df: DataFrame, y: str, index: str, *, by: list[str] = ()) -> DataFrame:
    """The pooled-variance t-test: statistic and two-sided p from Student's t law."""

    def test(a: Moments, b: Moments):
        df_ = a.n + b.n - 2
        pooled = (a.n * a.cov[0, 0] + b.n * b.cov[0, 0]) / df_
        t = (a.mean[0] - b.mean[0]) / math.sqrt(pooled * (1 / a.n + 1 / b.n)) if pooled > 0 else math.nan
        return t, 2 * t_cdf(-abs(t), df_)

    return _two_arms(df, y, index, list(by), test, "t_statistic double,p_value double")


def welch_ttest(df: DataFrame, y: str, index: str, *, by: list[str] = ()) -> DataFrame:
    """The unequal-variance t-test, with Welch's degrees of freedom."""

    def test(a: Moments, b: Moments):
        u, v = a.sample_cov()[0, 0] / a.n, b.sample_cov()[0, 0] / b.n
        if u + v <= 0:
            return math.nan, math.nan
        t = (a.mean[0] - b.mean[0]) / math.sqrt(u + v)
        return t, 2 * t_cdf(-abs(t), (u + v) ** 2 / (u * u / (a.n - 1) + v * v / (b.n - 1)))

    return _two_arms(df, y, index, list(by), test, "t_statistic double,p_value double")


def mean_z_test(df: DataFrame, y: str, index: str, variance0: float, variance1: float, confidence: float = 0.95, *, by: list[str] = ()) -> DataFrame:
    """The z-test of two means with known variances."""

    def test(a: Moments, b: Moments):
        se = math.sqrt(variance0 / a.n + variance1 / b.n)
        gap, q = a.mean[0] - b.mean[0], norm_ppf(0.5 + confidence / 2)
        return gap / se, 2 * norm_cdf(-abs(gap / se)), gap - q * se, gap + q * se

    return _two_arms(df, y, index, list(by), test, "z_statistic double,p_value double,lower double,upper double")


def xexpt_ttest_2samp(
    df: DataFrame, numerator: str, denominator: str, index: str, uin: str, *, metric: str = "avg", group_buckets: tuple[float, float] = (1, 1), alpha: float = 0.05, mde: float = 0.005, power: float = 0.8, x: str = "", buckets: int = 128
) -> DataFrame:
    """The bucketed experiment test of a ratio (or, for metric 'sum', of a total).

    Units are hashed into buckets; each bucket's sums are one observation, so rows of one unit needn't be independent. Arms are the two
    smallest values of ``index``. For 'sum' the denominator of an arm is its share of traffic. The bucket is pmod(xxhash64(uin), buckets), a hash of our own choice, so bucket values (not
    the law) are particular to it. Per-bucket sums are divided by the rows per bucket as a fraction, never as whole numbers. Returns for each arm its
    sums, rows and mean, and in the row of arm 1 the test: difference, relative difference with bounds, t, p, power, smallest effect that the power allows, and rows needed for the effect ``mde``.
    """
    if metric not in ("avg", "sum"):
        raise ValueError("metric must be avg or sum")
    covariates = [MeanFunction(t) for t in _terms(x)]
    extra: list[str] = []
    for f in covariates:
        extra += [a for a in f.args if a not in extra]
    sums = [numerator, denominator, *extra]
    bucket = F.pmod(F.xxhash64(F.expr(uin).cast("string")), F.lit(buckets))
    per = df.groupBy(F.expr(index).cast("string").alias("arm"), bucket.alias("bucket")).agg(F.count("*").alias("rows"), *[F.sum(expr_of(s)).alias(f"s{i}") for i, s in enumerate(sums)])
    per = per.where("arm is not null")
    arms = per.groupBy("arm").agg(F.sum("rows").alias("rows"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(len(sums))], *moment_columns([F.col(f"s{i}") for i in range(len(sums))]))
    both = arms.agg(F.sort_array(F.collect_list(F.struct(*arms.columns))).alias("arms"))
    schema = "arm string,numerator double,denominator double,rows long,mean double,diff double,diff_relative double,lower_relative double,upper_relative double,t_statistic double,p_value double,power double,mde double,recommended_rows double"

    def one(row):
        got = (row["arms"] or [])[:2]
        if len(got) < 2:
            return []
        share = sum(group_buckets)
        values, variances, cross, pre = [], [], [], []
        for i, a in enumerate(got):
            m = moments_of(a, len(sums))
            den = group_buckets[i] / share if metric == "sum" else a["t1"]
            n = float(m.n)
            cov = m.sample_cov() * n  # of totals over the buckets
            ratio = a["t0"] / den if den else math.nan
            grad = np.zeros((1 + len(covariates), len(sums)))
            grad[0, 0] = 1 / den if den else math.nan
            if metric == "avg":
                grad[0, 1] = -ratio / den if den else math.nan
            levels = []
            for j, f in enumerate(covariates):
                idx = [sums.index(z, 2) for z in f.args]
                d = f(np.array([a[f"t{q}"] for q in idx]))
                grad[1 + j, idx] = d.grad
                levels.append(d.value)
            c = grad @ cov @ grad.T
            values.append(ratio)
            variances.append(c)
            pre.append(np.array(levels))
        if covariates:
            pooled = variances[0] + variances[1]
            theta = np.linalg.pinv(pooled[1:, 1:]) @ pooled[0, 1:]
            centre = (pre[0] + pre[1]) / 2
            values = [v - theta @ (p - centre) for v, p in zip(values, pre, strict=True)]
            var = [float(c[0, 0] + theta @ c[1:, 1:] @ theta - 2 * theta @ c[0, 1:]) for c in variances]
        else:
            var = [float(c[0, 0]) for c in variances]
        gap, se = values[1] - values[0], math.sqrt(max(var[0] + var[1], 0))
        rows = sum(a["rows"] for a in got)
        _, _, t, p, lo, hi = judge(gap, se, rows, "two-sided", alpha)
        base = values[0] or math.nan
        z = norm_ppf(1 - alpha / 2)
        effect = abs(base) * mde
        reach = norm_cdf(effect / se - z) if se > 0 else math.nan
        least = (z + norm_ppf(power)) * se / abs(base)
        need = rows * (least / mde) ** 2
        lines = []
        for i, a in enumerate(got):
            head = (_label(a["arm"]), float(a["t0"]), float(a["t1"]), int(a["rows"]), float(values[i]))
            lines.append((*head, *((gap, gap / base, (lo or math.nan) / base, (hi or math.nan) / base, t, p, reach, least, need) if i else (None,) * 9)))
        return lines

    return finish(both, one, schema, [])


def srm(df: DataFrame, x: str, groupby: str, ratio: list[float]) -> DataFrame:
    """Sample-ratio mismatch: sums of ``x`` by group against the expected ratio, by chi-square. Groups are taken in ascending order."""
    sums = df.groupBy(F.expr(groupby).alias("g")).agg(F.sum(expr_of(x)).alias("s")).where("g is not null")
    all_ = sums.agg(F.sort_array(F.collect_list(F.struct("g", "s"))).alias("groups"))

    def one(row):
        got = row["groups"] or []
        if len(got) != len(ratio):
            raise ValueError(f"{len(got)} groups, but {len(ratio)} ratios")
        total = sum(g["s"] for g in got)
        expected = [r / sum(ratio) * total for r in ratio]
        chi = sum((g["s"] - e) ** 2 / e for g, e in zip(got, expected, strict=True))
        p = chi2_sf(chi, len(got) - 1)
        return [(str(g["g"]), float(g["s"]), float(e), float(chi), p) for g, e in zip(got, expected, strict=True)]

    return finish(all_, one, "groupname string,f_obs double,f_exp double,chisquare double,p_value double", [])


def _value_counts(df: DataFrame, y: str, index: str) -> DataFrame:
    """For each distinct value, how many rows of arm 0 and 1 have it: ties are one row, and sums are taken before the shuffle."""
    arm = F.expr(index).cast("int")
    return df.select(expr_of(y).alias("v"), arm.alias("arm")).where("v is not null and not isnan(v) and arm in (0, 1)").groupBy("v").agg(F.count_if(F.col("arm") == 0).alias("n0"), F.count_if(F.col("arm") == 1).alias("n1"))


def mann_whitney_utest(df: DataFrame, y: str, index: str, *, alternative: str = "two-sided", continuity_correction: int = 1) -> DataFrame:
    """The U statistic (of arm 1) and its p from the normal law, corrected for ties and, on demand, continuity."""
    c = running(_value_counts(df, y, index).withColumn("n", F.col("n0") + F.col("n1")), "v", ["n"])
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    n = F.col("n").cast("double")
    s = c.agg(F.sum("n0").cast("double").alias("n0"), F.sum("n1").cast("double").alias("n1"), F.sum(rank * F.col("n1")).alias("r1"), F.sum(n * n * n - n).alias("ties"))

    def one(row):
        n0, n1 = row["n0"] or 0, row["n1"] or 0
        if not n0 or not n1:
            return [(None, None)]
        u = row["r1"] - n1 * (n1 + 1) / 2
        n = n0 + n1
        sd = math.sqrt(n0 * n1 * (n + 1) / 12 * (1 - row["ties"] / (n**3 - n)))
        gap = u - n0 * n1 / 2
        half = 0.5 * continuity_correction
        if sd == 0:
            return [(u, 1.0)]
        if alternative == "two-sided":
            return [(u, min(1.0, 2 * norm_cdf(-max(abs(gap) - half, 0) / sd)))]
        return [(u, norm_cdf((gap + half) / sd) if alternative == "less" else norm_cdf(-(gap - half) / sd))]

    return finish(s, one, "u_statistic double,p_value double", [])


#: Rows of the larger arm up to which ``auto`` takes the exact law.
EXACT_KS = 10_000


def kolmogorov_exact_sf(n0: int, n1: int, d: float, alternative: str = "two-sided") -> float:
    """The chance of a gap of ``d`` or more between the distribution functions of samples of n0 and n1 from one law without ties.

    All orders of the pooled sample are equally likely. The share of orders that keep the gap below d is carried on from s to s + 1 values: of those with i
    of the first arm among s, i / s have one as their last.
    """
    most = (math.floor(d * n0 * n1 - 1e-7) + 0.5) / (n0 * n1)  # gaps are multiples of 1 / (n0 n1)
    up, down = most if alternative != "less" else math.inf, most if alternative != "greater" else math.inf
    i = np.arange(n0 + 1)
    share = np.zeros(n0 + 2)  # shifted by one: share[i + 1]
    share[1] = 1.0
    for s in range(1, n0 + n1 + 1):
        # i / n0 - (s - i) / n1 must lie between -down and up.
        lo = max(0, s - n1, math.ceil((s / n1 - down) * n0 * n1 / (n0 + n1)) if down < math.inf else 0)
        hi = min(n0, s, math.floor((s / n1 + up) * n0 * n1 / (n0 + n1)) if up < math.inf else n0)
        if lo > hi:
            return 1.0
        own = i[lo : hi + 1]
        new = own / s * share[lo : hi + 1] + (s - own) / s * share[lo + 1 : hi + 2]
        share[max(lo - 1, 0) : hi + 2] = 0.0
        share[lo + 1 : hi + 2] = new
    return float(min(1.0, max(0.0, 1 - share[n0 + 1])))


def kolmogorov_smirnov_test(df: DataFrame, y: str, index: str, *, alternative: str = "two-sided", mode: str = "auto") -> DataFrame:
    """The largest gap between the distribution functions of the two arms, and its p: from the exact law ("exact"), the limit law ("asymp"), or the exact one
    where no arm has more than ``EXACT_KS`` rows ("auto")."""
    if mode not in ("auto", "exact", "asymp"):
        raise ValueError(f"unknown mode {mode}")
    c = running(_value_counts(df, y, index), "v", ["n0", "n1"])
    totals = c.agg(F.sum("n0").alias("total0"), F.sum("n1").alias("total1"))
    gap = F.try_divide("cum_n0", "total0") - F.try_divide("cum_n1", "total1")
    s = c.crossJoin(F.broadcast(totals)).agg(F.max(gap).alias("above"), F.min(gap).alias("below"), F.max("total0").cast("double").alias("n0"), F.max("total1").cast("double").alias("n1"))

    def one(row):
        if not row["n0"] or not row["n1"]:
            return [(None, None)]
        d = {"two-sided": max(abs(row["above"]), abs(row["below"])), "less": max(-row["below"], 0.0), "greater": max(row["above"], 0.0)}[alternative]
        if mode == "exact" or (mode == "auto" and max(row["n0"], row["n1"]) <= EXACT_KS):
            return [(d, kolmogorov_exact_sf(int(row["n0"]), int(row["n1"]), d, alternative))]
        scale = math.sqrt(row["n0"] * row["n1"] / (row["n0"] + row["n1"]))
        return [(d, kolmogorov_sf(scale * d) if alternative == "two-sided" else math.exp(-2 * (scale * d) ** 2))]

    return finish(s, one, "d_statistic double,p_value double", [])


def pearsonr(df: DataFrame, x: str, y: str, *, by: list[str] = ()) -> DataFrame:
    """The correlation and its two-sided p from Student's t law with n - 2 degrees of freedom."""

    def one(row):
        m = moments_of(row, 2)
        d = math.sqrt(m.cov[0, 0] * m.cov[1, 1]) if m.n > 2 else 0
        if not d > 0:
            return [(None, None)]
        r = max(-1.0, min(1.0, m.cov[0, 1] / d))
        t = math.inf if abs(r) == 1 else r * math.sqrt((m.n - 2) / (1 - r * r))
        return [(r, 2 * t_cdf(-abs(t), m.n - 2))]

    return finish(grouped(df, [expr_of(x), expr_of(y)], [F.col(c) for c in by]), one, "r double,p_value double", list(by))


def ttest_1samp_of(values: list[float]) -> dict[str, float]:
    """Mean, standard deviation, t, p and +-1.96 standard deviations of replicate values."""
    v = np.asarray(values, float)
    mean, sd = float(v.mean()), float(v.std(ddof=1))
    t = mean / sd if sd else math.inf
    return {"mean": mean, "std": sd, "t": t, "p_value": 2 * t_cdf(-abs(t), len(v) - 1), "lower": mean - 1.96 * sd, "upper": mean + 1.96 * sd}
