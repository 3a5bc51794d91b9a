"""Linear, instrumental-variable and logistic regression from sums of cross products."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_sf, t_cdf, t_ppf
from .moments import Moments, expr_of, finish, grouped, moments_of

SUMMARY = "term string,estimate double,std_error double,t_statistic double,p_value double"
MODEL = "r_squared double,adj_r_squared double,f_statistic double,f_p_value double,residual_std_error double,df double,n long"


def split_terms(text: str) -> list[tuple[str, str]]:
    """Signed terms of a formula side, cut at + and - outside parentheses."""
    out, depth, word, sign = [], 0, "", "+"
    for c in text + "+":
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c in "+-" and not depth:
            if word.strip():
                out.append((sign, word.strip()))
            word, sign = "", c
        else:
            word += c
    return out


@dataclass
class Formula:
    """``y ~ x1 + x2``; ``- 1`` or ``+ 0`` drops the intercept. Terms are SQL expressions."""

    y: str
    x: list[str]
    intercept: bool = True

    @classmethod
    def parse(cls, text: str, use_bias: bool = True) -> Formula:
        if text.count("~") != 1:
            raise ValueError(f"a formula is y ~ x1 + x2, not {text!r}")
        y, rhs = text.split("~")
        terms = split_terms(rhs)
        drop = any((s, t) in (("-", "1"), ("+", "0")) for s, t in terms)
        return cls(y.strip(), [t for s, t in terms if t not in ("0", "1")], use_bias and not drop)


def solve(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, the inverse, and which columns were kept: a column that depends on those before it gets NaN."""
    keep: list[int] = []
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    a = xx / np.outer(scale, scale)
    for i in range(len(a)):
        own = [*keep, i]
        rest = a[i, i] - (a[i, keep] @ np.linalg.solve(a[np.ix_(keep, keep)], a[keep, i]) if keep else 0)
        if rest > 1e-10:
            keep = own
    inv = np.full_like(xx, np.nan)
    coef = np.full(len(xx), np.nan)
    if keep:
        small = np.linalg.inv(a[np.ix_(keep, keep)]) / np.outer(scale[keep], scale[keep])
        inv[np.ix_(keep, keep)] = small
        coef[keep] = small @ xy[keep]
    return coef, inv, np.array(keep, int)


@dataclass
class LinearModel:
    """A fitted linear model. Coefficients are in the order of the terms, the intercept last."""

    formula: Formula
    coef: np.ndarray
    inverse: np.ndarray
    n: int
    rss: float
    tss: float
    cov: np.ndarray | None = None

    @property
    def terms(self) -> list[str]:
        return [*self.formula.x, *(["intercept"] if self.formula.intercept else [])]

    @property
    def df(self) -> float:
        """n - k - 1 with k terms that aren't collinear, even without an intercept."""
        return self.n - int((~np.isnan(self.coef[: len(self.formula.x)])).sum()) - 1

    @property
    def sigma2(self) -> float:
        return self.rss / self.df if self.df > 0 else math.nan

    def covariance(self) -> np.ndarray:
        return self.cov if self.cov is not None else self.sigma2 * self.inverse

    def rows(self) -> list[tuple]:
        out = []
        for t, b, v in zip(self.terms, self.coef, np.diag(self.covariance()), strict=True):
            se = math.sqrt(v) if v > 0 else math.nan
            stat = float(b / se) if se > 0 else math.nan
            out.append((t, float(b), se, stat, 2 * t_cdf(-abs(stat), self.df) if not math.isnan(stat) else math.nan))
        return out

    def statistics(self) -> tuple:
        k = int((~np.isnan(self.coef[: len(self.formula.x)])).sum())
        r2 = 1 - self.rss / self.tss if self.tss > 0 else math.nan
        f = r2 / k / ((1 - r2) / self.df) if k and self.df > 0 and r2 < 1 else math.nan
        adj = 1 - (1 - r2) * (self.n - 1) / self.df if self.df > 0 else math.nan
        return r2, adj, f, f_sf(f, k, self.df) if not math.isnan(f) else math.nan, math.sqrt(self.sigma2) if self.sigma2 >= 0 else math.nan, float(self.df), int(self.n)

    def _columns(self) -> list[Column]:
        return [*[expr_of(t) for t in self.formula.x], *([F.lit(1.0)] if self.formula.intercept else [])]

    def predict(self) -> Column:
        """The prediction as an expression; coefficients that couldn't be told count as 0."""
        out = F.lit(0.0)
        for b, c in zip(self.coef, self._columns(), strict=True):
            out = out + float(0 if math.isnan(b) else b) * c
        return out

    def interval(self, kind: str = "confidence", level: float = 0.95) -> Column:
        """A struct of prediction, lower and upper bound; ``prediction`` adds the residual variance."""
        if kind not in ("confidence", "prediction"):
            raise ValueError("kind must be confidence or prediction")
        v, x, q = np.nan_to_num(self.covariance()), self._columns(), t_ppf(1 - (1 - level) / 2, self.df)
        se2 = F.lit(self.sigma2 if kind == "prediction" else 0.0)
        for i in range(len(x)):
            for j in range(len(x)):
                se2 = se2 + float(v[i, j]) * x[i] * x[j]
        half, p = q * F.sqrt(F.greatest(se2, F.lit(0.0))), self.predict()
        return F.struct(p.alias("prediction"), (p - half).alias("lower"), (p + half).alias("upper"))

    def effect(self, df: DataFrame, name: str = "effect") -> DataFrame:
        return df.withColumn(name, self.predict())


def linear_from_moments(m: Moments, formula: Formula) -> LinearModel:
    """The model from moments of (x..., y). With an intercept centred products are solved, which doesn't cancel."""
    k = len(formula.x)
    if m.n < 1:
        nan = np.full(k + formula.intercept, np.nan)
        return LinearModel(formula, nan, np.full((len(nan), len(nan)), np.nan), 0, math.nan, math.nan)
    n, mean, c = m.n, m.mean, m.cov * m.n
    if formula.intercept:
        b, inv, keep = solve(c[:k, :k], c[:k, k])
        use = np.nan_to_num(b)
        rss = c[k, k] - 2 * use @ c[:k, k] + use @ c[:k, :k] @ use
        full = np.full((k + 1, k + 1), np.nan)
        full[:k, :k] = inv
        small = inv[np.ix_(keep, keep)] if len(keep) else np.zeros((0, 0))
        mk = mean[keep]
        full[k, k] = 1 / n + mk @ small @ mk
        full[k, keep] = full[keep, k] = -small @ mk
        coef, inv = np.append(b, mean[k] - use @ mean[:k]), full
        tss = c[k, k]
    else:
        raw = c + n * np.outer(mean, mean)
        coef, inv, _ = solve(raw[:k, :k], raw[:k, k])
        use = np.nan_to_num(coef)
        rss = raw[k, k] - 2 * use @ raw[:k, k] + use @ raw[:k, :k] @ use
        tss = c[k, k]
    return LinearModel(formula, coef, inv, int(n), float(max(rss, 0)), float(tss))


def weighted_from_row(row, formula: Formula) -> LinearModel:
    """The model from sums of w, w x and w x y (see moments.moment_columns)."""
    k = len(formula.x)
    w, n = row["w"] or 0.0, int(row["n"] or 0)
    mean = np.array([(row[f"m{i}"] or 0.0) / w if w else math.nan for i in range(k + 1)])
    cov = np.array([[(row[f"c{min(i, j)}_{max(i, j)}"] or 0.0) / w - mean[i] * mean[j] if w else math.nan for j in range(k + 1)] for i in range(k + 1)])
    model = linear_from_moments(Moments(w, mean, cov), formula)
    return LinearModel(formula, model.coef, model.inverse, n, model.rss, model.tss)


def _values(formula: Formula) -> list[Column]:
    return [expr_of(t) for t in [*formula.x, formula.y]]


def fit_ols(df: DataFrame, formula: str | Formula, use_bias: bool = True) -> LinearModel:
    """One aggregation; the driver gets its single row of k (k + 1) / 2 sums."""
    f = formula if isinstance(formula, Formula) else Formula.parse(formula, use_bias)
    v = _values(f)
    return linear_from_moments(moments_of(grouped(df, v, []).first(), len(v)), f)


def fit_wls(df: DataFrame, formula: str | Formula, weight: str, use_bias: bool = True) -> LinearModel:
    f = formula if isinstance(formula, Formula) else Formula.parse(formula, use_bias)
    return weighted_from_row(grouped(df, _values(f), [], _weight(weight)).first(), f)


def _weight(weight: str) -> Column:
    w = expr_of(weight)
    return F.when(w < 0, F.raise_error(F.lit("a weight is negative")).cast("double")).otherwise(w)


def ols(df: DataFrame, formula: str, *, use_bias: bool = True, by: list[str] = ()) -> DataFrame:
    """A row for each term (and group): estimate, standard error, t and p, with the statistics of the model."""
    f = Formula.parse(formula, use_bias)

    def one(row):
        model = linear_from_moments(moments_of(row, len(f.x) + 1), f)
        return [(*r, *model.statistics()) for r in model.rows()]

    return finish(grouped(df, _values(f), [F.col(c) for c in by]), one, f"{SUMMARY},{MODEL}", list(by))


def wls(df: DataFrame, formula: str, weight: str, *, use_bias: bool = True, by: list[str] = ()) -> DataFrame:
    f = Formula.parse(formula, use_bias)

    def one(row):
        model = weighted_from_row(row, f)
        return [(*r, *model.statistics()) for r in model.rows()]

    return finish(grouped(df, _values(f), [F.col(c) for c in by], _weight(weight)), one, f"{SUMMARY},{MODEL}", list(by))


def did(df: DataFrame, y: str, treatment: str, time: str, *x: str) -> DataFrame:
    """Difference in differences: regression on treatment, time, their product and covariates."""
    return ols(df, f"{y} ~ {' + '.join([f'({treatment})', f'({time})', f'({treatment}) * ({time})', *x])}")


def fit_did(df: DataFrame, y: str, treatment: str, time: str, x: list[str] = ()) -> LinearModel:
    return fit_ols(df, f"{y} ~ {' + '.join([f'({treatment})', f'({time})', f'({treatment}) * ({time})', *x])}")


def matrix_multiplication(df: DataFrame, *cols: str, invert: bool = False, weighted: bool = False) -> np.ndarray:
    """X'X of the columns. ``weighted``: the last column multiplies every other one first, so products carry its square."""
    values = [expr_of(c) for c in cols]
    if weighted:
        values = [v * values[-1] for v in values[:-1]]
    k = len(values)
    r = df.agg(*[F.sum(values[i] * values[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    out = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return np.linalg.inv(out) if invert else out


@dataclass
class IVFormula:
    y: str
    endogenous: list[str]
    instruments: list[str]
    exogenous: list[str]

    @classmethod
    def parse(cls, text: str) -> IVFormula:
        m = re.fullmatch(r"\s*(.+?)\s*~\s*\(\s*(.+?)\s*~\s*(.+?)\s*\)\s*(?:\+\s*(.+))?", text)
        if not m:
            raise ValueError(f"an instrumental-variable formula is y ~ (t ~ z) + x, not {text!r}")
        part = lambda s: [t for _, t in split_terms(s)] if s else []
        return cls(m[1], part(m[2]), part(m[3]), part(m[4]))


def fit_iv(df: DataFrame, formula: str) -> LinearModel:
    """Two-stage least squares with the heteroskedasticity-robust (HC0) covariance.

    The first pass gives all cross products, of which both stages are made; the second sums e^2 times the
    products of the second stage's columns, with e from the true treatment. Columns and errors are in one order throughout.
    """
    f = IVFormula.parse(formula)
    names = [*f.instruments, *f.exogenous, *f.endogenous, f.y]
    m = moments_of(grouped(df, [expr_of(t) for t in names], []).first(), len(names))
    pos = {t: i for i, t in enumerate(names)}
    z = [pos[t] for t in [*f.instruments, *f.exogenous]]
    firsts = []
    for t in f.endogenous:
        idx = [*z, pos[t]]
        firsts.append(linear_from_moments(Moments(m.n, m.mean[idx], m.cov[np.ix_(idx, idx)]), Formula(t, [names[i] for i in z])))
    # The second stage's columns are linear in the observed ones: products follow without another pass.
    k = len(f.endogenous) + len(f.exogenous)
    turn, shift = np.zeros((k + 1, len(names))), np.zeros(k + 1)
    for r, model in enumerate(firsts):
        turn[r, z] = np.nan_to_num(model.coef[:-1])
        shift[r] = model.coef[-1]
    for r, t in enumerate(f.exogenous, len(f.endogenous)):
        turn[r, pos[t]] = 1
    turn[k, pos[f.y]] = 1
    second = linear_from_moments(Moments(m.n, turn @ m.mean + shift, turn @ m.cov @ turn.T), Formula(f.y, [*f.endogenous, *f.exogenous]))
    hats = [*[model.predict() for model in firsts], *[expr_of(t) for t in f.exogenous], F.lit(1.0)]
    true = Formula(f.y, [*f.endogenous, *f.exogenous])
    e = expr_of(f.y) - LinearModel(true, second.coef, second.inverse, 0, 0, 0).predict()
    sums = df.agg(*[F.sum(e * e * hats[i] * hats[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)], F.sum(e * e).alias("rss")).first()
    meat = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    inv = np.nan_to_num(second.inverse)
    return LinearModel(true, second.coef, second.inverse, int(m.n), float(sums["rss"]), second.tss, inv @ meat @ inv)


def summary(df: DataFrame, model: LinearModel) -> DataFrame:
    """A fitted model's terms as a DataFrame."""
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v.item() if isinstance(v, np.generic) else v
    return df.sparkSession.createDataFrame([tuple(map(clean, (*r, *model.statistics()))) for r in model.rows()], f"{SUMMARY},{MODEL}")


def iv_regression(df: DataFrame, formula: str) -> DataFrame:
    return summary(df, fit_iv(df, formula))


class Logistic:
    """Logistic regression by Newton steps; each is one aggregation of weighted cross products."""

    def __init__(self, tol: float = 1e-12, iterations: int = 500):
        self.tol, self.iterations = tol, iterations

    def fit(self, y: str, x: list[str], df: DataFrame) -> Logistic:
        self.x = list(x)
        cols, target = [*[expr_of(c) for c in x], F.lit(1.0)], expr_of(y)
        k = len(cols)
        self.coef = np.full(k, 0.001)
        before = None
        for _ in range(self.iterations):
            eta = self._eta(cols)
            p = 1 / (1 + F.exp(-eta))
            ll = F.when(target > 0.5, -F.log1p(F.exp(-F.abs(eta))) + F.least(eta, F.lit(0.0))).otherwise(-F.log1p(F.exp(-F.abs(eta))) - F.greatest(eta, F.lit(0.0)))
            w = p * (1 - p)
            sums = [F.sum(w * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum((target - p) * c).alias(f"g{i}") for i, c in enumerate(cols)]
            r = df.agg(*sums, F.sum(ll).alias("ll")).first()
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
            self.log_likelihood = r["ll"]
            if before is not None and abs(r["ll"] - before) / (abs(r["ll"]) + 0.1) <= self.tol:
                break
            before = r["ll"]
            step, inv, _ = solve(h, np.array([r[f"g{i}"] for i in range(k)], float))
            self.inverse = inv
            self.coef = self.coef + np.nan_to_num(step)
        return self

    def _eta(self, cols: list[Column]) -> Column:
        out = F.lit(0.0)
        for b, c in zip(self.coef, cols, strict=True):
            out = out + float(b) * c
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self._eta([*[expr_of(c) for c in self.x], F.lit(1.0)])))

    def predict(self, df: DataFrame, prob_col: str = "prob") -> DataFrame:
        return df.withColumn(prob_col, self.probability())

    def get_auc(self, df: DataFrame, y: str, prob_col: str = "prob") -> float:
        return auc(df, y, prob_col).first()[0]

    def summary(self, df: DataFrame) -> DataFrame:
        se = np.sqrt(np.maximum(np.diag(self.inverse), 0))
        return df.sparkSession.createDataFrame([(t, float(b), float(s)) for t, b, s in zip([*self.x, "intercept"], self.coef, se, strict=True)], "term string,estimate double,std_error double")


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """The area under the ROC curve over all rows, exactly: the rank sum of the positives, ties at their mean rank."""
    from .hypothesis import _value_counts
    from .ranges import running

    c = running(_value_counts(df, score, f"case when ({y}) > 0 then 1 else 0 end").withColumn("n", F.col("n0") + F.col("n1")), "v", ["n"])
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    s = c.agg(F.sum(rank * F.col("n1")).alias("r"), F.sum("n1").cast("double").alias("p"), F.sum("n0").cast("double").alias("q"))
    return s.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """Points (threshold, false and true positive rate) at each distinct score, the highest first."""
    from .hypothesis import _value_counts
    from .ranges import running

    c = running(_value_counts(df, score, f"case when ({y}) > 0 then 1 else 0 end").withColumn("down", -F.col("v")), "down", ["n0", "n1"])
    total = c.agg(F.sum("n0").alias("q"), F.sum("n1").alias("p"))
    return c.crossJoin(F.broadcast(total)).select(F.col("v").alias("threshold"), F.try_divide("cum_n0", "q").alias("fpr"), F.try_divide("cum_n1", "p").alias("tpr"))


class _Stochastic:
    """A model of the MLlib family, trained over the whole table in each round (so it doesn't depend on the order of rows, as per-batch steps would)."""

    def __init__(self, learning_rate: float = 1e-5, l1: float = 0.1, batch_size: int = 15, method: str = "SGD", iterations: int = 100):
        if method not in ("SGD", "Momentum", "Nesterov", "Adam", "Lasso"):
            raise ValueError(f"unknown method {method}")
        self.l1, self.method, self.iterations = l1, method, iterations

    def _frame(self, df: DataFrame, f: Formula) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        rows = df.select(expr_of(f.y).alias("label"), *[expr_of(t).alias(f"x{i}") for i, t in enumerate(f.x)]).na.drop()
        return VectorAssembler(inputCols=[f"x{i}" for i in range(len(f.x))], outputCol="features").transform(rows)

    def fit(self, formula: str, df: DataFrame):
        self.formula = Formula.parse(formula)
        model = self._model().fit(self._frame(df, self.formula))
        self.coef = np.append(np.array(model.coefficients), model.intercept if self.formula.intercept else [])
        return self

    def _linear(self) -> Column:
        return LinearModel(self.formula, self.coef, np.zeros((1, 1)), 0, 0, 0).predict()


class StochasticLinearRegression(_Stochastic):
    def _model(self):
        from pyspark.ml.regression import LinearRegression

        lasso = self.method == "Lasso"
        return LinearRegression(maxIter=self.iterations, regParam=self.l1 if lasso else 0.0, elasticNetParam=float(lasso), fitIntercept=self.formula.intercept, solver="auto")

    def effect(self, df: DataFrame, name: str = "effect") -> DataFrame:
        return df.withColumn(name, self._linear())


class StochasticLogisticRegression(_Stochastic):
    def _model(self):
        from pyspark.ml.classification import LogisticRegression

        lasso = self.method == "Lasso"
        return LogisticRegression(maxIter=self.iterations, regParam=self.l1 if lasso else 0.0, elasticNetParam=float(lasso), fitIntercept=self.formula.intercept)

    def effect(self, df: DataFrame, name: str = "effect") -> DataFrame:
        return df.withColumn(name, 1 / (1 + F.exp(-self._linear())))
