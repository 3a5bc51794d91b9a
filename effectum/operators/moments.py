"""Sufficient statistics: counts, means and covariances in one aggregation, and functions of means."""

from __future__ import annotations

import ast
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expr_of(x: str | Column) -> Column:
    return (F.expr(x) if isinstance(x, str) else x).cast("double")


@dataclass
class Moments:
    """n, means and centred sums of products (divided by n) of k variables."""

    n: float
    mean: np.ndarray
    cov: np.ndarray  # population covariances

    def sample_cov(self) -> np.ndarray:
        return self.cov * self.n / (self.n - 1) if self.n > 1 else np.full_like(self.cov, math.inf)

    @staticmethod
    def merge(parts: list[Moments]) -> Moments:
        """Moments of the rows of all parts together."""
        n = sum(p.n for p in parts)
        mean = sum(p.n * p.mean for p in parts) / n
        cov = sum(p.n * (p.cov + np.outer(p.mean - mean, p.mean - mean)) for p in parts) / n
        return Moments(n, mean, cov)


def moment_columns(values: list[Column], weight: Column | None = None) -> list[Column]:
    """Aggregates of n, each mean and each covariance, over the rows in which no value is null.

    Every aggregate is combined before the shuffle. Covariances are updated around the mean, so large means
    don't cancel. With a weight, sums of w, w x and w x y are taken instead.
    """
    ok = F.lit(True)
    for v in values:
        ok = ok & v.isNotNull()
    if weight is not None:
        ok = ok & weight.isNotNull()
    out: list[Column] = []
    if weight is None:
        masked = [F.when(ok, v) for v in values]
        out.append(F.count_if(ok).cast("double").alias("n"))
        out += [F.avg(v).alias(f"m{i}") for i, v in enumerate(masked)]
        out += [F.covar_pop(masked[i], masked[j]).alias(f"c{i}_{j}") for i in range(len(values)) for j in range(i, len(values))]
    else:
        w = F.when(ok, weight)
        out.append(F.count_if(ok).cast("double").alias("n"))
        out.append(F.sum(w).alias("w"))
        out += [F.sum(w * v).alias(f"m{i}") for i, v in enumerate(values)]
        out += [F.sum(w * values[i] * values[j]).alias(f"c{i}_{j}") for i in range(len(values)) for j in range(i, len(values))]
    return out


def moments_of(row, k: int, prefix: str = "") -> Moments:
    """Moments from a row (or mapping) of the unweighted aggregates above; no rows give n = 0 and NaN."""
    get = lambda name: math.nan if row[prefix + name] is None else float(row[prefix + name])
    cov = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = get(f"c{i}_{j}")
    return Moments(float(row[prefix + "n"] or 0), np.array([get(f"m{i}") for i in range(k)]), cov)


def grouped(df: DataFrame, values: list[Column], by: list[Column], weight: Column | None = None) -> DataFrame:
    return df.groupBy(*by).agg(*moment_columns(values, weight)) if by else df.agg(*moment_columns(values, weight))


# Functions of means


class Dual:
    """A number and its derivatives, for arithmetic on functions of means."""

    def __init__(self, value: float, grad: np.ndarray):
        self.value, self.grad = value, grad

    def __add__(self, o: Dual) -> Dual:
        return Dual(self.value + o.value, self.grad + o.grad)

    def __sub__(self, o: Dual) -> Dual:
        return Dual(self.value - o.value, self.grad - o.grad)

    def __mul__(self, o: Dual) -> Dual:
        return Dual(self.value * o.value, self.grad * o.value + o.grad * self.value)

    def __truediv__(self, o: Dual) -> Dual:
        if o.value == 0:
            return Dual(math.nan, self.grad * math.nan)
        q = self.value / o.value
        return Dual(q, (self.grad - q * o.grad) / o.value)

    def __neg__(self) -> Dual:
        return Dual(-self.value, -self.grad)


class MeanFunction:
    """An arithmetic expression over means, as ``avg(a) / avg(b)``; a bare column name is its mean.

    What stands in ``avg( )`` is any SQL expression. ``args`` has each one once.
    """

    def __init__(self, text: str):
        self.text, self.args = text, []
        out, at = "", 0
        for m in re.finditer(r"\b(?:avg|mean)\s*\(", text, re.IGNORECASE):
            if m.start() < at:
                continue
            depth, stop = 1, m.end()
            while depth:
                if stop >= len(text):
                    raise ValueError(f"a parenthesis isn't closed in {text!r}")
                depth += {"(": 1, ")": -1}.get(text[stop], 0)
                stop += 1
            out += text[at : m.start()] + self._slot(text[m.end() : stop - 1].strip())
            at = stop
        self.tree = ast.parse((out + text[at:]).strip(), mode="eval").body
        self._check(self.tree)

    def _slot(self, arg: str) -> str:
        if arg not in self.args:
            self.args.append(arg)
        return f"_mean_{self.args.index(arg)}"

    def _check(self, node: ast.AST) -> None:
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add | ast.Sub | ast.Mult | ast.Div):
            self._check(node.left)
            self._check(node.right)
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            self._check(node.operand)
        elif isinstance(node, ast.Name):
            if not node.id.startswith("_mean_"):
                node.id = self._slot(node.id)
        elif not (isinstance(node, ast.Constant) and isinstance(node.value, int | float)):
            raise ValueError(f"only + - * /, numbers and means may stand in {self.text!r}")

    def columns(self) -> list[Column]:
        return [expr_of(a) for a in self.args]

    def __call__(self, mean: np.ndarray) -> Dual:
        """Value and gradient at the means of ``args``."""
        zero = np.zeros(len(mean))

        def walk(node) -> Dual:
            if isinstance(node, ast.Constant):
                return Dual(float(node.value), zero)
            if isinstance(node, ast.Name):
                i = int(node.id[6:])
                return Dual(float(mean[i]), np.eye(len(mean))[i])
            if isinstance(node, ast.UnaryOp):
                v = walk(node.operand)
                return -v if isinstance(node.op, ast.USub) else v
            a, b = walk(node.left), walk(node.right)
            return {ast.Add: a.__add__, ast.Sub: a.__sub__, ast.Mult: a.__mul__, ast.Div: a.__truediv__}[type(node.op)](b)

        return walk(self.tree)


def finish(stats: DataFrame, function, schema: str, by: list[str]) -> DataFrame:
    """Apply ``function`` (mapping of a row's statistics -> list of result tuples) to each of the few rows of an aggregate.

    The result stays a lazy DataFrame, so statistics can be grouped, joined and written. ``by`` columns come first.
    """
    from pyspark.sql.types import StructType

    out = StructType([*[stats.schema[c] for c in by], *StructType.fromDDL(schema).fields])

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(*[r[c] for c in by], *result) for r in f.to_dict("records") for result in function({k: v.tolist() if isinstance(v, np.ndarray) else None if isinstance(v, float) and math.isnan(v) else v for k, v in r.items()})]
            made = pd.DataFrame(rows, columns=out.names)
            for field in out.fields[len(by) :]:
                if field.dataType.typeName() == "double":
                    made[field.name] = pd.to_numeric(made[field.name], errors="coerce")
                elif field.dataType.typeName() in ("long", "integer"):
                    made[field.name] = made[field.name].astype("Int64")
            yield made

    return stats.mapInPandas(run, out)
