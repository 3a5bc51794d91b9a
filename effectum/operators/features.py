"""Bins, indicators, descriptions, survival and long-term forecasts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .moments import expr_of
from .ranges import exact_quantiles
from .regression import Formula, fit_ols

NUMBERS = ("count", "avg", "std", "min", "quantile_0.25", "quantile_0.5", "quantile_0.75", "quantile_0.9", "quantile_0.99", "max")


def cut_bins(column: str | Column, bins: list[float], if_string: bool = True) -> Column:
    """Half-open bins: below the first bound, between two, from the last on. As labels, or numbered from 1."""
    c = F.expr(column) if isinstance(column, str) else column
    show = lambda v: f"{v:g}"
    labels = [f"<{show(bins[0])}", *[f"[{show(a)},{show(b)})" for a, b in zip(bins, bins[1:], strict=False)], f">={show(bins[-1])}"]
    out = F.when(c < bins[0], F.lit(labels[0] if if_string else 1))
    for i, b in enumerate(bins[1:], 1):
        out = out.when(c < b, F.lit(labels[i] if if_string else i + 1))
    return out.when(c >= bins[-1], F.lit(labels[-1] if if_string else len(bins) + 1))


class Bucketizer:
    """Bins by given bounds, or by exact quantiles."""

    def __init__(self, input_cols: list[str], splits: list[list[float]] | None = None, quantiles: list[float] = (0.25, 0.5, 0.75, 0.9, 0.95), output_cols: list[str] | None = None, if_string: bool = True):
        self.cols, self.splits, self.quantiles, self.if_string = list(input_cols), splits, list(quantiles), if_string
        self.out = output_cols or [f"{c}_buckets" for c in input_cols]

    def fit(self, df: DataFrame) -> DataFrame:
        if self.splits is None:
            self.splits = [sorted(set(exact_quantiles(df, c, self.quantiles))) for c in self.cols]
        return df.withColumns({o: cut_bins(c, s, self.if_string) for o, c, s in zip(self.out, self.cols, self.splits, strict=True)})


class OneHotEncoder:
    """0 / 1 columns for all levels but the first, in the order of their text. Null counts as no level."""

    def fit(self, df: DataFrame, cols: list[str], most: int = 1000) -> DataFrame:
        # Levels are counted first, so that a column with millions of them is an error before any of them reaches one task.
        counts = df.agg(*[F.approx_count_distinct(F.col(c).cast("string")).alias(c) for c in cols]).first()
        for c in cols:
            if counts[c] > 1.2 * most:
                raise ValueError(f"{c} has more than {most} levels")
        levels = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cols]).first()
        new = {}
        for c in cols:
            if len(levels[c]) > most:
                raise ValueError(f"{c} has more than {most} levels")
            for v in levels[c][1:]:
                new[f"{c}_{v}"] = F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0))
        return df.withColumns(new)


def describe(df: DataFrame, cols: list[str] | str = "*") -> DataFrame:
    """For each numeric column a row of count, mean, deviation, extremes and quantiles; one aggregation."""
    own = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)] if cols == "*" else list(cols)
    aggs = []
    for i, c in enumerate(own):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"count{i}"), F.avg(v).alias(f"avg{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), F.percentile_approx(v, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.99))), F.lit(10_000)).alias(f"q{i}")]
    lines = []
    for i, c in enumerate(own):
        q = {n: F.get(f"q{i}", F.lit(k)) for k, n in enumerate(NUMBERS[4:9])}
        lines.append(F.struct(F.lit(c).alias("column"), *[q[n].alias(n) if n in q else F.col(f"{n}{i}").cast("double" if n != "count" else "long").alias(n) for n in NUMBERS]))
    return df.agg(*aggs).select(F.inline(F.array(*lines)))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlations of all pairs: a, b, corr. One aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    r = df.agg(*[F.corr(expr_of(a), expr_of(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return r.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Counts of values of text, or in bins of equal width of a number."""
    if not isinstance(df.schema[col].dataType, NumericType):
        return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    lo, hi = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if lo is None or lo == hi:
        return df.where(F.col(col).isNotNull()).groupBy(F.lit(1).cast("long").alias("bin"), F.lit(lo).alias("from")).agg(F.count("*").alias("n"))
    b = F.least(F.floor((expr_of(col) - lo) / ((hi - lo) / bins)) + 1, F.lit(bins)).cast("long")
    return df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("from", lo + (F.col("bin") - 1) * ((hi - lo) / bins))


def five_numbers(df: DataFrame, col: str) -> DataFrame:
    """Minimum, quartiles and maximum, and the whiskers 1.5 interquartile ranges out."""
    out = df.sparkSession.createDataFrame([tuple(exact_quantiles(df, col, [0, 0.25, 0.5, 0.75, 1]))], "minimum double, q1 double, median double, q3 double, maximum double")
    iqr = F.col("q3") - F.col("q1")
    return out.withColumn("lower_whisker", F.greatest("minimum", F.col("q1") - 1.5 * iqr)).withColumn("upper_whisker", F.least("maximum", F.col("q3") + 1.5 * iqr))


def preprocess_na(df: DataFrame, str_replace: str = "-1", numeric_replace: float = 0) -> DataFrame:
    return df.fillna(str_replace, [n for n, t in df.dtypes if t == "string"]).fillna(numeric_replace, [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)])


def kaplan_meier(df: DataFrame, time: str, event: str | None = None) -> DataFrame:
    """The survival curve: time, at_risk, events, survival. Rows whose ``event`` is 0 are censored: at risk until their time, no event.

    Times are grouped first; the running product is over distinct times.
    """
    hit = F.lit(1) if event is None else F.expr(event).cast("int")
    per = df.select(F.expr(time).alias("time"), hit.alias("e")).where("time is not null and e is not null").groupBy("time").agg(F.count("*").alias("n"), F.sum("e").alias("events"))
    total = per.agg(F.sum("n").alias("total"))
    from .ranges import range_bounds, running

    bounds = range_bounds(per, "time")
    c = running(per, "time", ["n"], bounds).crossJoin(F.broadcast(total)).withColumn("at_risk", F.col("total") - F.col("cum_n") + F.col("n"))
    # A logarithm of zero is kept apart: from such a time on nobody survives.
    c = c.withColumn("log", F.when(F.col("events") < F.col("at_risk"), F.log1p(-F.col("events") / F.col("at_risk"))).otherwise(0.0)).withColumn("dead", (F.col("events") >= F.col("at_risk")).cast("long"))
    c = running(c.select("time", "at_risk", "events", "log", "dead"), "time", ["log", "dead"], bounds)
    return c.select("time", "at_risk", "events", F.when(F.col("cum_dead") > 0, 0.0).otherwise(F.exp("cum_log")).alias("survival"))


class LongTerm:
    """Effects after the experiment, from surrogates that are rolled forward period by period.

    In each arm each period's surrogates are regressed on those of the period before (over the periods of training) and
    the key metric follows in the same step; the last observed period is then carried on. The arms' means give the effect, Poisson weights its interval.
    """

    def __init__(self, unit: str, time: str, treatment: str, surrogates: list[str], train: tuple[int, int], predict: list[int], key_metric: int = 0, n_bootstraps: int = 100, seed: int = 0):
        self.unit, self.time, self.treatment, self.surrogates = unit, time, treatment, list(surrogates)
        self.train, self.horizon, self.key, self.B, self.seed = train, list(predict), key_metric, n_bootstraps, seed

    def fit(self, df: DataFrame) -> LongTerm:
        from .resampling import weighted_sums

        a, b = self.train
        s = self.surrogates
        wide = df.groupBy(F.expr(self.unit).alias("unit"), F.expr(self.treatment).cast("int").alias("arm")).agg(
            *[F.max(F.when(F.expr(self.time) == p, expr_of(c))).alias(f"{c}_{w}") for p, w in ((a, "x"), (b, "y")) for c in s]
        )
        self.steps = {}
        for arm in (0, 1):
            rows = wide.where(F.col("arm") == arm)
            models = [fit_ols(rows, Formula(f"{c}_y", [f"{x}_x" for x in s])) for c in s]
            self.steps[arm] = np.array([m.coef for m in models])  # one row a surrogate: slopes, intercept
        last = wide.where(F.col("arm").isin(0, 1) & F.col(f"{s[0]}_y").isNotNull())
        sums = weighted_sums(last, [F.col(f"{c}_y") for c in s], F.lit(1.0), "unit", range(self.B + 1), 1.0, self.seed, [F.col("arm")], point=True)
        means = {(row["g0"], row["replicate"]): np.array([row[f"s{i}"] / row["w"] for i in range(len(s))]) for row in sums.collect()}
        self.results = []
        for p in self.horizon:
            values = []
            for r in range(self.B + 1):
                level = []
                for arm in (0, 1):
                    m = means[arm, r]
                    for _ in range(p - b):
                        m = np.nan_to_num(self.steps[arm][:, :-1]) @ m + self.steps[arm][:, -1]
                    level.append(m[self.key])
                values.append(level[1] - level[0])
            rest = np.array(values[1:])
            self.results.append((p, float(values[0]), float(rest.std(ddof=1)) if self.B > 1 else None, float(np.quantile(rest, 0.025)) if self.B else None, float(np.quantile(rest, 0.975)) if self.B else None))
        self._spark = df.sparkSession
        return self

    def get_results(self) -> DataFrame:
        return self._spark.createDataFrame(self.results, "period int,effect double,std double,lower double,upper double")


