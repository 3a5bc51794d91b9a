"""A DataFrame with the methods of an analyst: relational steps, statistics and models in one object."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalar
from .operators import features, hypothesis, matching, regression, resampling, uplift
from .sources import tables

#: Rows that ``show`` prints; plans themselves have no limit.
SHOWN = 200
_JOINS = {"inner": "inner", "full": "full", "outer": "full", "left": "left", "right": "right", "semi": "left_semi", "anti": "left_anti", "cross": "cross", "left semi": "left_semi", "left anti": "left_anti", "full outer": "full", "left outer": "left", "right outer": "right"}


def _column(x: str | Column) -> Column:
    return F.expr(x) if isinstance(x, str) else x


class Frame:
    """A lazy table. Every method returns a new Frame, or a value where that is said; nothing runs before a result is asked for."""

    def __init__(self, df: DataFrame, grouping: list[str | Column] | None = None):
        self.df, self.grouping = df, grouping

    def __getitem__(self, key: str) -> Column:
        return self.df[key]

    # Relational steps

    def select(self, *args: str | Column) -> Frame:
        return Frame(self.df.select(*map(_column, args)))

    def drop(self, *args: str) -> Frame:
        missing = [a for a in args if a not in self.df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        return Frame(self.df.drop(*args))

    def withColumn(self, name: str, value: str | Column) -> Frame:
        return Frame(self.df.withColumn(name, _column(value)))

    def withColumnRenamed(self, old: str, new: str) -> Frame:
        if old not in self.df.columns:
            raise ValueError(f"no such column: {old}")
        return Frame(self.df.withColumnRenamed(old, new))

    def where(self, condition: str | Column) -> Frame:
        """After ``agg`` this filters the aggregates, as HAVING does."""
        return Frame(self.df.where(_column(condition)), self.grouping)

    filter = where

    def groupBy(self, *args: str | Column) -> Frame:
        return Frame(self.df, list(args))

    def agg(self, *args: Column | dict[str, str]):
        """Aggregates by the grouping; a single aggregate without one is returned as a value."""
        cols: list[Column] = []
        for a in args:
            cols += [F.expr(f"{fn}({c})").alias(f"{fn}({c})") for c, fn in a.items()] if isinstance(a, dict) else [_column(a)]
        if self.grouping:
            return Frame(self.df.groupBy(*map(_column, self.grouping)).agg(*cols))
        out = self.df.agg(*cols)
        return out.first()[0] if len(cols) == 1 else Frame(out)

    def join(self, rhs: Frame, *on: str, type: str = "inner") -> Frame:
        """``on``: column names, or conditions over ``lhs.`` and ``rhs.``. Columns that lhs has already aren't repeated; semi and anti joins have those of lhs only."""
        how = _JOINS.get(type.lower().replace("_", " "))
        if how is None:
            raise ValueError(f"unknown join type {type}")
        l, r = self.df.alias("lhs"), rhs.df.alias("rhs")
        cond = [F.expr(o) if any(c in o for c in "=<>. ") else F.col(f"lhs.`{o}`") == F.col(f"rhs.`{o}`") for o in on]
        whole = None
        for c in cond:
            whole = c if whole is None else whole & c
        joined = l.crossJoin(r) if how == "cross" and whole is None else l.join(r, whole, "inner" if how == "cross" else how)
        if how in ("left_semi", "left_anti"):
            return Frame(joined)
        keys = {o for o in on if o in self.df.columns}
        left = [F.coalesce(F.col(f"lhs.`{c}`"), F.col(f"rhs.`{c}`")).alias(c) if how in ("right", "full") and c in keys else F.col(f"lhs.`{c}`") for c in self.df.columns]
        return Frame(joined.select(*left, *[F.col(f"rhs.`{c}`") for c in rhs.df.columns if c not in self.df.columns]))

    def union(self, other: Frame) -> Frame:
        """All rows of both, whose columns must have the same names in the same order."""
        if self.df.columns != other.df.columns:
            raise ValueError("the columns differ")
        return Frame(self.df.union(other.df))

    def sample(self, fraction: float, seed: int = 0) -> Frame:
        """A share of the rows, each kept by chance; above 1 it is the number of rows aimed at."""
        return Frame(self.df.sample(min(1.0, fraction / max(self.df.count(), 1)) if fraction > 1 else fraction, seed))

    def split(self, test_size: float = 0.5, seed: int = 0) -> tuple[Frame, Frame]:
        train, test = self.df.randomSplit([1 - test_size, test_size], seed)
        return Frame(train), Frame(test)

    def orderBy(self, *args: str | Column) -> Frame:
        return Frame(self.df.orderBy(*map(_column, args)))

    def describe(self, cols: list[str] | str = "*") -> Frame:
        return Frame(features.describe(self.df, cols))

    def head(self, n: int = 5) -> Frame:
        return Frame(self.df.limit(n))

    take = head

    def first(self):
        return self.df.first()

    def show(self, n: int = SHOWN) -> None:
        self.df.show(n)

    def printSchema(self) -> None:
        self.df.printSchema()

    def dtypes(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def columns(self) -> list[str]:
        return self.df.columns

    def brief(self) -> dict[str, int]:
        return {"rows": self.df.count(), "columns": len(self.df.columns)}

    def materializedView(self, name: str, is_physical_table: bool = False) -> Frame:
        """Save the plan as a view, or its rows as a table, and read from there."""
        if is_physical_table:
            tables.write_table(self.df, name, replace=True)
        else:
            self.df.createOrReplaceTempView(name)
        return Frame(self.df.sparkSession.table(name))

    def getTableName(self) -> str:
        """The name of a temporary view of these rows, made when it is first asked for; SQL text can read it."""
        if not hasattr(self, "_view"):
            self._view = f"effectum_{uuid.uuid4().hex}"
            self.df.createOrReplaceTempView(self._view)
        return self._view

    def getExecutedSql(self) -> str:
        """The optimised plan as text."""
        return self.df._jdf.queryExecution().optimizedPlan().toString()

    # Sinks

    def toPandas(self):
        return self.df.toPandas()

    def toCsv(self, path: str) -> None:
        tables.write_csv(self.df, path)

    def toSparkDf(self) -> DataFrame:
        return self.df

    def toTable(self, name: str, is_drop_table: bool = False) -> None:
        tables.write_table(self.df, name, replace=is_drop_table)

    # Single aggregates, over the grouping where there is one

    def _one(self, c: Column):
        return self.agg(c)

    def sum(self, c: str):
        return self._one(F.sum(_column(c)).alias(f"sum({c})"))

    def avg(self, c: str):
        return self._one(F.avg(_column(c)).alias(f"avg({c})"))

    def count(self, *, expr: str = "*"):
        return self._one(F.count(F.expr(expr) if expr != "*" else F.lit(1)).alias(f"count({expr})"))

    def max(self, c: str):
        return self._one(F.max(_column(c)).alias(f"max({c})"))

    def min(self, c: str):
        return self._one(F.min(_column(c)).alias(f"min({c})"))

    def any(self, c: str):
        return self._one(F.any_value(_column(c)).alias(f"any({c})"))

    def stddevPop(self, c: str):
        return self._one(F.stddev_pop(_column(c)).alias(f"stddevPop({c})"))

    def stddevSamp(self, c: str):
        return self._one(F.stddev_samp(_column(c)).alias(f"stddevSamp({c})"))

    def varPop(self, c: str):
        return self._one(F.var_pop(_column(c)).alias(f"varPop({c})"))

    def varSamp(self, c: str):
        return self._one(F.var_samp(_column(c)).alias(f"varSamp({c})"))

    def corr(self, x: str, y: str):
        return self._one(F.corr(_column(x), _column(y)).alias(f"corr({x}, {y})"))

    def covarPop(self, x: str, y: str):
        return self._one(F.covar_pop(_column(x), _column(y)).alias(f"covarPop({x}, {y})"))

    def covarSamp(self, x: str, y: str):
        return self._one(F.covar_samp(_column(x), _column(y)).alias(f"covarSamp({x}, {y})"))

    def anyLast(self, x: str, order: str):
        return self._one(scalar.any_last(x, order).alias(f"anyLast({x})"))

    def anyMin(self, x: str, y: str):
        return self._one(scalar.any_min(x, y).alias(f"anyMin({x}, {y})"))

    def anyMax(self, x: str, y: str):
        return self._one(scalar.any_max(x, y).alias(f"anyMax({x}, {y})"))

    def quantile(self, x: str, level: float = 0.5, exact: bool = False):
        return self._one(scalar.quantile(x, level, exact).alias(f"quantile({x})"))

    def quantiles(self, x: str, *levels: float, exact: bool = False):
        return self._one(scalar.quantiles(x, *levels, exact=exact).alias(f"quantiles({x})"))

    # Statistics: by the grouping where the operator knows groups

    def _by(self, function, *args, **how) -> Frame:
        return Frame(function(self.df, *args, by=list(self.grouping or []), **how))

    def delta_method(self, expression: str, std: bool = False) -> Frame:
        return self._by(hypothesis.delta_method, expression, std=std)

    def ttest_1samp(self, y: str, alternative: str = "two-sided", mu: float = 0, X: str = "") -> Frame:
        return self._by(hypothesis.ttest_1samp, y, alternative=alternative, mu=mu, x=X)

    def ttest_2samp(self, y: str, index: str, alternative: str = "two-sided", X: str = "", pse: str = "") -> Frame:
        return self._by(hypothesis.ttest_2samp, y, index, alternative=alternative, x=X, pse=pse)

    def ttests_2samp(self, y: str, index: str, alternative: str = "two-sided", X: str = "") -> Frame:
        return self._by(hypothesis.ttests_2samp, y, index, alternative=alternative, x=X)

    def xexpt_ttest_2samp(self, numerator: str, denominator: str, index: str, uin: str, metric_type: str = "avg", group_buckets=(1, 1), alpha: float = 0.05, MDE: float = 0.005, power: float = 0.8, X: str = "") -> Frame:
        return Frame(hypothesis.xexpt_ttest_2samp(self.df, numerator, denominator, index, uin, metric=metric_type, group_buckets=tuple(group_buckets), alpha=alpha, mde=MDE, power=power, x=X))

    def mann_whitney_utest(self, y: str, index: str, alternative: str = "two-sided", continuity_correction: int = 1) -> Frame:
        return Frame(hypothesis.mann_whitney_utest(self.df, y, index, alternative=alternative, continuity_correction=continuity_correction))

    def kolmogorov_smirnov_test(self, y: str, index: str, **how: str) -> Frame:
        return Frame(hypothesis.kolmogorov_smirnov_test(self.df, y, index, **how))

    def student_ttest(self, y: str, index: str) -> Frame:
        return self._by(hypothesis.student_ttest, y, index)

    def welch_ttest(self, y: str, index: str) -> Frame:
        return self._by(hypothesis.welch_ttest, y, index)

    def mean_z_test(self, y: str, index: str, variance_x: float, variance_y: float, confidence_level: float = 0.95) -> Frame:
        return self._by(hypothesis.mean_z_test, y, index, variance_x, variance_y, confidence_level)

    def srm(self, x: str, groupby: str, ratio: list[float] = (1, 1)) -> Frame:
        return Frame(hypothesis.srm(self.df, x, groupby, list(ratio)))

    def ols(self, formula: str, use_bias: bool = True) -> Frame:
        return self._by(regression.ols, formula, use_bias=use_bias)

    def wls(self, formula: str, weight: str, use_bias: bool = True) -> Frame:
        return self._by(regression.wls, formula, weight, use_bias=use_bias)

    def stochastic_linear_regression(self, formula: str, **how) -> regression.StochasticLinearRegression:
        return regression.StochasticLinearRegression(**how).fit(formula, self.df)

    def stochastic_logistic_regression(self, formula: str, **how) -> regression.StochasticLogisticRegression:
        return regression.StochasticLogisticRegression(**how).fit(formula, self.df)

    def matrix_multiplication(self, *cols: str, invert: bool = False, weighted: bool = False):
        return regression.matrix_multiplication(self.df, *cols, invert=invert, weighted=weighted)

    def did(self, y: str, treatment: str, time: str, *x: str) -> Frame:
        return Frame(regression.did(self.df, y, treatment, time, *x))

    def iv_regression(self, formula: str) -> Frame:
        return Frame(regression.iv_regression(self.df, formula))

    def boot_strap(self, expression: str, key: str, resample_frac: float = 1, n_resamples: int = 100, seed: int = 0) -> Frame:
        return Frame(resampling.boot_strap(self.df, expression, key, resample_frac=resample_frac, n_resamples=n_resamples, seed=seed))

    def permutation(self, y: str, index: str, key: str, permutation_num: int = 100, **how) -> Frame:
        return Frame(resampling.permutation(self.df, y, index, key, permutation_num=permutation_num, **how))

    def get_lift_gain(self, ite: str, y: str, t: str, K: int = 1000, **how) -> Frame:
        return Frame(uplift.get_lift_gain(self.df, ite, y, t, K=K, **how))

    def smd(self, treatment: str, cols: list[str]) -> Frame:
        return Frame(matching.smd(self.df, treatment, cols))
