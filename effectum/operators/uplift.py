"""Heterogeneous effects: lift curves, double machine learning, causal trees and forests, uplift learners and their evaluation."""

from __future__ import annotations

import json
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import norm_cdf, norm_ppf
from .moments import expr_of, moments_of
from .regression import Formula, LinearModel, fit_ols, fit_wls, linear_from_moments
from .ranges import running
from .resampling import uniform, weighted_sums

# Lift


def get_lift_gain(df: DataFrame, ite: str, y: str, t: str, *, K: int = 1000, normalize: bool = True, discrete_treatment: bool = True) -> DataFrame:
    """The curve of effects as ever more rows are treated, the highest ``ite`` first, at K points: ratio, lift, gain, ate, random_gain.

    Rows with equal ``ite`` are one from the start, so the most frequent value costs no more than another; where they fall in several buckets, each gets its
    share of their sums, as in the mean over all their orders. For a treatment that isn't 0 or 1 the slope of y on t is the effect.
    """
    rows = df.select(expr_of(ite).alias("ite"), expr_of(y).alias("y"), expr_of(t).alias("t")).where("ite is not null and y is not null and t is not null")
    sums = {"n": F.count("*"), "t": F.sum("t"), "y": F.sum("y"), "ty": F.sum(F.col("t") * F.col("y")), "tt": F.sum(F.col("t") * F.col("t"))}
    values = rows.groupBy((-F.col("ite")).alias("down")).agg(*[v.alias(c) for c, v in sums.items()])
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "bucket long, ratio double, lift double, gain double, ate double, random_gain double")
    k = min(K, n)
    size, left = divmod(n, k)
    # The first k - left buckets have ``size`` rows, the others one more.
    cut = (k - left) * size
    place = lambda at: F.when(at <= cut, F.ceil(at / max(size, 1))).otherwise(k - left + F.ceil((at - cut) / (size + 1))).cast("long")
    end = lambda bucket: F.when(bucket <= k - left, bucket * size).otherwise(cut + (bucket - (k - left)) * (size + 1))
    spans = running(values, "down", ["n"]).withColumn("first", F.col("cum_n") - F.col("n"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(place(F.col("first") + 1), place(F.col("cum_n")))))
    share = (F.least("cum_n", end(F.col("bucket"))) - F.greatest("first", end(F.col("bucket") - 1))) / F.col("n")
    per = spans.groupBy("bucket").agg(*[F.sum(F.col(c).cast("double") * share).alias(c) for c in sums])
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # K rows at most
    c = per.select("bucket", *[F.sum(x).over(w).alias(x) for x in sums])
    if discrete_treatment:
        effect = F.try_divide("ty", "t") - F.try_divide(F.col("y") - F.col("ty"), F.col("n") - F.col("t"))
    else:
        effect = F.try_divide(F.col("n") * F.col("ty") - F.col("t") * F.col("y"), F.col("n") * F.col("tt") - F.col("t") * F.col("t"))
    out = c.select("bucket", (F.col("n") / n).alias("ratio"), effect.alias("lift"))
    out = out.withColumn("gain", F.col("lift") * F.col("ratio"))
    last = F.last("lift").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("ate", last).withColumn("random_gain", F.col("ratio") * F.col("ate"))
    if normalize:
        for name in ("gain", "random_gain", "lift"):
            out = out.withColumn(name, F.try_divide(F.col(name), F.abs("ate")))
    return out


def auuc(curve: DataFrame) -> float:
    """The mean gain over the points of a curve."""
    return curve.agg(F.avg("gain")).first()[0]


# Double machine learning


def fold_of(key: str, cv: int, seed: int = 0) -> Column:
    """The fold of a row, by a hash of its key: the same in any partitioning."""
    return F.pmod(F.xxhash64(F.expr(key), F.lit(seed)), F.lit(cv)).cast("int")


def cross_fit(df: DataFrame, y: str, x: list[str], fold: Column, cv: int) -> Column:
    """Predictions of y by models that didn't see the row's fold. One aggregation by fold; the moments of the others are merged."""
    from .moments import Moments, grouped

    f = Formula(y, list(x))
    values = [expr_of(v) for v in [*x, y]]
    got = {r["fold"]: moments_of(r, len(values)) for r in grouped(df.withColumn("fold", fold), values, [F.col("fold")]).collect()}
    out = F.lit(None).cast("double")
    for i in range(cv):
        others = [m for k, m in got.items() if k != i and m.n > 0]
        if others:
            out = F.when(fold == i, linear_from_moments(Moments.merge(others), f).predict()).otherwise(out)
    return out


class LinearDML:
    """Residuals of outcome and treatment, cross-fitted on W and X, regressed on each other with effects linear in X."""

    def __init__(self, key: str, cv: int = 2, seed: int = 0):
        self.key, self.cv, self.seed = key, cv, seed

    def residuals(self, df: DataFrame, y: str, t: str, x: list[str], w: list[str]) -> DataFrame:
        controls, fold = [*x, *w], fold_of(self.key, self.cv, self.seed)
        return df.withColumn("__ry", expr_of(y) - cross_fit(df, y, controls, fold, self.cv)).withColumn("__rt", expr_of(t) - cross_fit(df, t, controls, fold, self.cv))

    def fit(self, df: DataFrame, y: str, t: str, x: list[str] = (), w: list[str] = ()) -> LinearDML:
        self.x, self.data = list(x), df
        r = self.residuals(df, y, t, list(x), list(w))
        self.model = self._final(r)
        return self

    def _final(self, r: DataFrame) -> LinearModel:
        return fit_ols(r, Formula("__ry", ["__rt", *[f"__rt * ({c})" for c in self.x]], intercept=False))

    def _parts(self) -> list[Column]:
        return [F.lit(1.0), *[expr_of(c) for c in self.x]]

    def const_marginal_effect(self) -> Column:
        out = F.lit(0.0)
        for b, c in zip(self.model.coef, self._parts(), strict=True):
            out = out + float(np.nan_to_num(b)) * c
        return out

    marginal_effect = const_marginal_effect

    def effect(self, df: DataFrame, T0: float = 0, T1: float = 1, name: str = "effect") -> DataFrame:
        return df.withColumn(name, self.const_marginal_effect() * float(T1 - T0))

    def effect_interval(self, df: DataFrame, T0: float = 0, T1: float = 1, alpha: float = 0.05) -> DataFrame:
        v, p, se2 = np.nan_to_num(self.model.covariance()), self._parts(), F.lit(0.0)
        for i in range(len(p)):
            for j in range(len(p)):
                se2 = se2 + float(v[i, j]) * p[i] * p[j]
        half, e = norm_ppf(1 - alpha / 2) * F.sqrt(F.greatest(se2, F.lit(0.0))) * abs(T1 - T0), self.const_marginal_effect() * float(T1 - T0)
        return df.withColumns({"effect": e, "lower": e - half, "upper": e + half})

    def _mean(self) -> np.ndarray:
        r = self.data.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(self._parts())]).first()
        return np.array([r[f"a{i}"] for i in range(len(self.x) + 1)], float)

    def ate(self, T0: float = 0, T1: float = 1) -> float:
        return float(self._mean() @ np.nan_to_num(self.model.coef) * (T1 - T0))

    marginal_ate = ate

    def ate_interval(self, T0: float = 0, T1: float = 1, alpha: float = 0.05) -> tuple[float, float]:
        m = self._mean()
        half = norm_ppf(1 - alpha / 2) * math.sqrt(m @ np.nan_to_num(self.model.covariance()) @ m) * abs(T1 - T0)
        return self.ate(T0, T1) - half, self.ate(T0, T1) + half


class NonParamDML(LinearDML):
    """The final stage regresses y's residual over t's on X, weighted by the square of t's."""

    def _final(self, r: DataFrame) -> LinearModel:
        return fit_wls(r.where("__rt <> 0").withColumn("__ratio", F.col("__ry") / F.col("__rt")), Formula("__ratio", ["1.0", *self.x], intercept=False), "__rt * __rt")


# Causal trees


@dataclass
class Node:
    id: int
    depth: int
    rule: str
    n: int = 0
    effect: float = math.nan
    stderr: float = math.nan
    p_value: float = math.nan
    split: tuple[str, float] | None = None
    children: list[int] = field(default_factory=list)


def _bins(df: DataFrame, x: list[str], bins: int) -> dict[str, list[float]]:
    levels = [i / bins for i in range(1, bins)]
    r = df.agg(*[F.percentile_approx(expr_of(c), F.array(*map(F.lit, levels)), F.lit(1000)).alias(f"q{i}") for i, c in enumerate(x)]).first()
    return {c: sorted(set(r[f"q{i}"] or []), key=lambda v: (v != v, v)) for i, c in enumerate(x)}


def _bin(c: str, cuts: list[float]) -> Column:
    """How many cuts the value is above: rows in bin b are below or at cut b."""
    return sum((F.when(expr_of(c) > v, 1).otherwise(0) for v in cuts), F.lit(0))


def _tables(rows: list, cuts: list[list[float]]) -> dict[tuple, list[np.ndarray]]:
    """By tree and node for each feature an array of n, sum and sum of squares by bin and arm."""
    out: dict[tuple, list[np.ndarray]] = {}
    for tree, node, f, b, t, n, s, q in rows:
        a = out.get((tree, node))
        if a is None:
            a = out[tree, node] = [np.zeros((len(c) + 1, 2, 3)) for c in cuts]
        a[f][int(b), t] = n, s or 0.0, q or 0.0
    return out


def group_set(df: DataFrame, features: list[str], y: str, t: str, by: list[str] = ()) -> DataFrame:
    """Sufficient statistics by feature, its value and arm: col, treatment, value, cnt, sum, sum2. Arms other than 0 and 1 are ignored."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.expr(c).cast("double").alias("value")) for c in features])).alias("f")
    rows = df.where(F.expr(t).cast("int").isin(0, 1)).select(*by, F.expr(t).cast("int").alias("treatment"), expr_of(y).alias("y"), pairs)
    return rows.groupBy(*by, F.col("f.col").alias("col"), "treatment", F.col("f.value").alias("value")).agg(F.count("y").alias("cnt"), F.sum("y").alias("sum"), F.sum(F.col("y") * F.col("y")).alias("sum2"))


class CausalTree:
    """An honest tree: half of the rows (by a hash of the key) choose the splits, the others estimate the effects of the leaves.

    Each level is one aggregation, keyed by node, feature, bin and arm, over all nodes of the level.
    """

    def __init__(self, key: str, depth: int = 3, min_sample_ratio_leaf: float = 0.001, bins: int = 10, min_arm: int = 100, seed: int = 0):
        self.key, self.depth, self.least, self.bins, self.min_arm, self.seed = key, depth, min_sample_ratio_leaf, bins, min_arm, seed

    def _walk(self, value) -> Column:
        """What ``value`` says of a row's leaf: splits are tested from the root."""

        def walk(i: int) -> Column:
            n = self.nodes[i]
            if not n.children:
                return value(n)
            c, v = n.split
            return F.when(expr_of(c) <= v, walk(n.children[0])).otherwise(walk(n.children[1]))

        return walk(0)

    def _node(self) -> Column:
        return self._walk(lambda n: F.lit(n.id))

    def _effect(self) -> Column:
        return self._walk(lambda n: F.lit(None if math.isnan(n.effect) else float(n.effect)).cast("double"))

    def fit(self, y: str, t: str, x: list[str], df: DataFrame) -> CausalTree:
        self.x, self.nodes = list(x), [Node(0, 0, "true")]
        test = fold_of(self.key, 2, self.seed) == 1
        cuts = _bins(df, x, self.bins)
        binned = [F.struct(F.lit(i).alias("f"), _bin(c, cuts[c]).cast("double").alias("b")) for i, c in enumerate(x)]
        train = df.where(~test)
        total = train.count()
        level = [0]
        for _ in range(self.depth):
            rows = train.select(self._node().alias("node"), expr_of(t).cast("int").alias("t"), expr_of(y).alias("y"), F.explode(F.array(*binned)).alias("k")).where(F.col("node").isin(*level) & F.col("t").isin(0, 1))
            got = rows.groupBy("node", "k.f", "k.b", "t").agg(F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).collect()
            sums = _tables([(0, *r) for r in got], [cuts[c] for c in x])
            after: list[int] = []
            for node in level:
                best = self._best(sums.get((0, node)), range(len(x)), cuts, total)
                if best:
                    f, cut = best
                    n = self.nodes[node]
                    n.split = x[f], cut
                    for op in ("<=", ">"):
                        self.nodes.append(Node(len(self.nodes), n.depth + 1, f"{n.rule} and {x[f]} {op} {cut!r}"))
                        n.children.append(self.nodes[-1].id)
                        after.append(self.nodes[-1].id)
            level = after
            if not level:
                break
        self._estimate(df.where(test), y, t)
        return self

    def _best(self, sums: list[np.ndarray] | None, features, cuts: dict, total: int) -> tuple[int, float] | None:
        """The split with the largest gain in 0.5 tau^2 n less the variance, both children having enough rows in both arms."""
        best, gain = None, 0.0
        for f in features if sums else ():
            c = self.x[f]
            left = np.cumsum(sums[f], 0)
            whole = left[-1]
            for i, cut in enumerate(cuts[c]):
                l_, r_ = left[i], whole - left[i]
                if min(l_[:, 0].min(), r_[:, 0].min()) <= self.min_arm or min(l_[:, 0].sum(), r_[:, 0].sum()) <= self.least * total:
                    continue
                g = _worth(l_) + _worth(r_) - _worth(whole)
                if g > gain:
                    best, gain = (f, cut), g
        return best

    def _estimate(self, df: DataFrame, y: str, t: str) -> None:
        v, arm = expr_of(y), expr_of(t).cast("int")
        rows = df.select(self._node().alias("leaf"), arm.alias("t"), v.alias("y")).where("t in (0, 1)").groupBy("leaf", "t").agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v")).collect()
        for n in self.nodes:
            arms = {r["t"]: r for r in rows if r["leaf"] == n.id}
            n.n = sum(r["n"] for r in arms.values())
            if len(arms) == 2 and min(r["n"] for r in arms.values()) > 1:
                n.effect = arms[1]["m"] - arms[0]["m"]
                n.stderr = math.sqrt(arms[1]["v"] / arms[1]["n"] + arms[0]["v"] / arms[0]["n"])
                n.p_value = 2 * norm_cdf(-abs(n.effect) / n.stderr) if n.stderr else 0.0

    def leaves(self) -> list[Node]:
        return [n for n in self.nodes if not n.children]

    def effect(self, df: DataFrame, name: str = "effect") -> DataFrame:
        """Appends the leaf's effect; null where a leaf has none."""
        return df.withColumn(name, self._effect())

    def get_decision_rules(self) -> str:
        return "\n".join(f"{'  ' * n.depth}{n.rule.rpartition(' and ')[2]}: n={n.n} effect={n.effect:.6g}" for n in self.nodes)

    def variable_importance(self) -> dict[str, int]:
        return {c: sum(n.split is not None and n.split[0] == c for n in self.nodes) for c in self.x}

    def rules(self, df: DataFrame) -> DataFrame:
        """The leaves as a table, which ``predict_by_rules`` applies."""
        return df.sparkSession.createDataFrame([(n.id, n.rule, n.n, None if math.isnan(n.effect) else n.effect) for n in self.leaves()], "leaf int,rule string,n long,effect double")


def _worth(a: np.ndarray) -> float:
    n, s, q = a[:, 0], a[:, 1], a[:, 2]
    if n.min() < 2:
        return 0.0
    m = s / n
    var = np.maximum(q / n - m**2, 0)
    total = n.sum()
    return 0.5 * (m[1] - m[0]) ** 2 * total - total * (var / n).sum() / total


def predict_by_rules(df: DataFrame, rules: DataFrame, name: str = "effect") -> DataFrame:
    """Predictions from a stored table of leaves (a few rows): one CASE expression."""
    out = F.lit(None).cast("double")
    for r in rules.collect():
        if r["effect"] is not None:
            out = F.when(F.expr(r["rule"]), r["effect"]).otherwise(out)
    return df.withColumn(name, out)


class CausalForest:
    """Trees over hashed subsamples, grown together.

    Trees see a row's cell only, which is its bins of all features. Where there are few cells, one aggregation by tree, honest half, cell and arm has
    all that growing and estimating need; otherwise each level is one aggregation keyed by tree, node, feature, bin and arm.
    A row's membership of a tree and its honest half are hashes of its key; features of a node are drawn by its number. Effects of leaves are
    from the honest half; a prediction is the mean over trees.
    """

    #: Sums of cells, over all trees, that the driver takes at most.
    CELLS = 1_000_000

    def __init__(self, key: str, depth: int = 5, num_trees: int = 20, mtry: int = 3, min_node_ratio: float = 1 / 128, sample_ratio: float = 0.5, bins: int = 10, seed: int = 0):
        if num_trees > 200 or mtry > 30:
            raise ValueError("at most 200 trees and 30 features a node")
        self.key, self.depth, self.trees, self.mtry, self.least, self.share, self.bins, self.seed = key, depth, num_trees, mtry, min_node_ratio, sample_ratio, bins, seed

    def fit(self, y: str, t: str, x: list[str], df: DataFrame) -> CausalForest:
        self.x = list(x)
        self.members = []
        cuts = _bins(df, x, self.bins)
        self.cuts = [cuts[c] for c in x]
        base = df.select(F.expr(self.key).alias("__key"), expr_of(t).cast("int").alias("__t"), expr_of(y).alias("__y"), *[expr_of(c).alias(f"__x{i}") for i, c in enumerate(x)]).where("__t in (0, 1)")
        total = base.count()
        for _ in range(self.trees):
            tree = CausalTree("__key", bins=self.bins)
            tree.x, tree.nodes = [f"__x{i}" for i in range(len(x))], [Node(0, 0, "true")]
            tree.least, tree.min_arm = self.least * self.share / 2, 10
            self.members.append(tree)
        mine = {f"__x{i}": c for i, c in enumerate(self.cuts)}
        levels = {k: [0] for k in range(self.trees)}
        rng = np.random.default_rng(self.seed)
        cells = self._cell_sums(base) if self._few() else None
        for _ in range(self.depth):
            if not any(levels.values()):
                break
            sums = self._level_sums(base) if cells is None else self._level_of_cells(cells[:, 0], levels)
            for k, tree in enumerate(self.members):
                after: list[int] = []
                for node in levels[k]:
                    chosen = set(rng.permutation(len(x))[: max(1, min(len(x), self.mtry))].tolist())
                    best = tree._best(sums.get((k, node)), sorted(chosen), mine, total)
                    if best:
                        n = tree.nodes[node]
                        n.split = tree.x[best[0]], best[1]
                        for op in ("<=", ">"):
                            tree.nodes.append(Node(len(tree.nodes), n.depth + 1, f"{n.rule} and {x[best[0]]} {op} {best[1]!r}"))
                            n.children.append(tree.nodes[-1].id)
                            after.append(tree.nodes[-1].id)
                levels[k] = after
        for (k, node), a in (self._leaf_sums(base) if cells is None else self._leaves_of_cells(cells[:, 1])).items():
            if a[:, 0].min() > 0:
                n = self.members[k].nodes[node]
                n.n, n.effect = int(a[:, 0].sum()), float(a[1, 1] / a[1, 0] - a[0, 1] / a[0, 0])
        return self

    # Cells

    def _sizes(self) -> list[int]:
        """For each feature its bins, and one for null, which counts in the first bin when splits are chosen and goes right like any value that isn't below the cut."""
        return [len(c) + 2 for c in self.cuts]

    def _few(self) -> bool:
        return 4 * max(self.trees, 1) * math.prod(self._sizes()) <= self.CELLS

    def _cell(self) -> Column:
        out = F.lit(0)
        for i, (c, size) in enumerate(zip(self.cuts, self._sizes(), strict=True)):
            out = out * size + F.when(F.col(f"__x{i}").isNull(), size - 1).otherwise(_bin(f"__x{i}", c))
        return out

    def _digits(self) -> list[np.ndarray]:
        """For each feature the bin of every cell."""
        return list(np.unravel_index(np.arange(math.prod(self._sizes())), self._sizes()))

    def _cell_sums(self, base: DataFrame) -> np.ndarray:
        """n, sum and sum of squares by tree, half (0: for splits, 1: honest), cell and arm."""
        out = np.zeros((self.trees, 2, math.prod(self._sizes()), 2, 3))
        got = self._members(base.select("__key", "__t", "__y", self._cell().alias("cell"))).groupBy("tree", "half", "cell", "__t").agg(F.count("__y").alias("n"), F.sum("__y").alias("s"), F.sum(F.col("__y") * F.col("__y")).alias("q")).toPandas()
        out[got["tree"], got["half"], got["cell"], got["__t"]] = got[["n", "s", "q"]].fillna(0.0).to_numpy(float)
        return out

    def _node_of_cells(self, k: int, digits: list[np.ndarray]) -> np.ndarray:
        at = np.zeros(len(digits[0]) if digits else 1, int)
        for n in self.members[k].nodes:  # parents come before their children
            if n.children:
                f = int(n.split[0][3:])
                right = digits[f] > self.cuts[f].index(n.split[1])
                at = np.where(at == n.id, np.where(right, n.children[1], n.children[0]), at)
        return at

    def _level_of_cells(self, cells: np.ndarray, levels: dict) -> dict[tuple, list[np.ndarray]]:
        digits, out = self._digits(), {}
        for k, nodes in levels.items():
            at = self._node_of_cells(k, digits) if nodes else None
            for node in nodes:
                own = at == node
                out[k, node] = []
                for d, c in zip(digits, self.cuts, strict=True):
                    a = np.zeros((len(c) + 1, 2, 3))
                    np.add.at(a, np.where(d > len(c), 0, d)[own], cells[k][own])
                    out[k, node].append(a)
        return out

    def _leaves_of_cells(self, cells: np.ndarray) -> dict[tuple, np.ndarray]:
        digits, out = self._digits(), {}
        for k, tree in enumerate(self.members):
            at = self._node_of_cells(k, digits)
            out |= {(k, n.id): cells[k][at == n.id].sum(0) for n in tree.leaves()}
        return out

    # Rows

    def _members(self, rows: DataFrame) -> DataFrame:
        """A row for each tree that has it, with the half."""
        u = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1)))).withColumn("__u", uniform(self.seed, F.col("__key"), F.col("tree"), "forest"))
        return u.where(F.col("__u") < self.share).withColumn("half", (F.col("__u") >= self.share / 2).cast("int")).drop("__u", "__key")

    def _placed(self, base: DataFrame, half: int) -> DataFrame:
        """The rows of a half with their node. Trees are constant arrays in which each step looks up the node's feature, cut and left child, so the code doesn't grow with the trees."""
        most = max(len(tree.nodes) for tree in self.members)

        def constant(value, kind: str) -> Column:
            flat = [value(n) for tree in self.members for n in tree.nodes + [Node(0, 0, "")] * (most - len(tree.nodes))]
            return F.split(F.lit(",".join(map(str, flat))), ",").cast(f"array<{kind}>")

        feature = constant(lambda n: int(n.split[0][3:]) if n.children else 0, "int")
        cut = constant(lambda n: n.split[1] if n.children else 0.0, "double")
        left = constant(lambda n: n.children[0] if n.children else 0, "int")
        rows = base.select("__key", "__t", "__y", F.array(*[F.col(f"__x{i}") for i in range(len(self.x))]).alias("__x"))
        rows = self._members(rows).where(F.col("half") == half).withColumn("node", F.lit(0))
        for _ in range(max(n.depth for tree in self.members for n in tree.nodes)):
            rows = rows.withColumn("__i", F.col("tree") * most + F.col("node"))
            below = F.coalesce(F.get("__x", F.get(feature, F.col("__i"))) <= F.get(cut, F.col("__i")), F.lit(False))
            rows = rows.withColumn("__l", F.get(left, F.col("__i"))).withColumn("node", F.when(F.col("__l") == 0, F.col("node")).when(below, F.col("__l")).otherwise(F.col("__l") + 1))
        return rows.select("tree", "node", "__t", "__y", "__x")

    def _level_sums(self, base: DataFrame) -> dict[tuple, list[np.ndarray]]:
        """Of all leaves so far. A filter on the node would be pushed below the steps that find it and double them."""
        binned = [F.struct(F.lit(i).alias("f"), sum((F.when(F.get("__x", F.lit(i)) > v, 1).otherwise(0) for v in c), F.lit(0)).alias("b")) for i, c in enumerate(self.cuts)]
        rows = self._placed(base, 0).select("tree", "node", "__t", "__y", F.explode(F.array(*binned)).alias("k"))
        got = rows.groupBy("tree", "node", "k.f", "k.b", "__t").agg(F.count("__y").alias("n"), F.sum("__y").alias("s"), F.sum(F.col("__y") * F.col("__y")).alias("q")).collect()
        return _tables(got, self.cuts)

    def _leaf_sums(self, base: DataFrame) -> dict[tuple, np.ndarray]:
        out: dict[tuple, np.ndarray] = {}
        for r in self._placed(base, 1).groupBy("tree", "node", "__t").agg(F.count("__y").alias("n"), F.sum("__y").alias("s")).collect():
            out.setdefault((r["tree"], r["node"]), np.zeros((2, 2)))[r["__t"]] = r["n"], r["s"] or 0.0
        return out

    def effect(self, df: DataFrame, name: str = "effect") -> DataFrame:
        """Appends the mean over the trees that have an effect for the row; null where none has."""
        rows = df.withColumns({f"__x{i}": expr_of(c) for i, c in enumerate(self.x)})
        own = [f"__x{i}" for i in range(len(self.x))]
        if self._few():
            digits, s, known = self._digits(), 0.0, 0
            for k, tree in enumerate(self.members):
                e = np.array([n.effect for n in tree.nodes])[self._node_of_cells(k, digits)]
                s, known = s + np.where(np.isnan(e), 0.0, e), known + ~np.isnan(e)
            means = ",".join(repr(float(a / b)) if b else "" for a, b in zip(s, known, strict=True)) if self.members else ""
            return rows.withColumn(name, F.get(F.split(F.lit(means), ",").try_cast("array<double>"), self._cell())).drop(*own)
        # A tree's effect is used twice in the next step, so the steps stay apart and no tree is tested twice.
        rows = rows.withColumns({"__s": F.lit(0.0), "__n": F.lit(0), "__e": F.lit(None).cast("double")})
        for tree in [*self.members, None]:
            e = F.col("__e")
            rows = rows.withColumns({"__s": F.col("__s") + F.coalesce(e, F.lit(0.0)), "__n": F.col("__n") + e.isNotNull().cast("int")} | ({"__e": tree._effect()} if tree else {}))
        return rows.withColumn(name, F.col("__s") / F.nullif("__n", F.lit(0))).drop(*own, "__s", "__n", "__e")

    def variable_importance(self) -> dict[str, float]:
        counts = {c: 0 for c in self.x}
        for tree in self.members:
            for n in tree.nodes:
                if n.split:
                    counts[self.x[int(n.split[0][3:])]] += 1
        whole = sum(counts.values()) or 1
        return {c: v / whole for c, v in counts.items()}

    def structure(self) -> str:
        """The trees as JSON."""
        return json.dumps([[{"id": n.id, "rule": n.rule, "n": n.n, "effect": None if math.isnan(n.effect) else n.effect} for n in tree.nodes] for tree in self.members])


def save_model(model, file: str) -> None:
    with open(file, "wb") as f:
        pickle.dump(model, f)


def load_model(file: str):
    """Only for files that one has written oneself: unpickling runs code."""
    with open(file, "rb") as f:
        return pickle.load(f)


# Uplift learners


class _Learner:
    """Uplift from models of the outcome: linear ones (logistic for probabilities), each of them one aggregation, or any of MLlib's.

    ``base_model`` is a class of MLlib, such as ``GBTRegressor`` or, for probabilities, ``RandomForestClassifier``; ``base_model_params`` are its parameters.
    """

    def __init__(self, y: str, t: str, x: list[str], propensity: float | str = 0.5, *, base_model: type | None = None, base_model_params: dict | None = None):
        self.y, self.t, self.x, self.p = y, t, list(x), propensity
        self.base_model, self.params = base_model, dict(base_model_params or {})

    def _arm(self, df: DataFrame, arm: int) -> DataFrame:
        return df.where(expr_of(self.t) == arm)

    def _features(self, arm: Column | None = None) -> list[Column]:
        return [expr_of(c) for c in self.x] + ([] if arm is None else [arm])

    def predict(self, df: DataFrame, name: str = "cate_outcome") -> DataFrame:
        if self.base_model is None:
            return df.withColumn(name, self._cate())
        out = self._with_outcomes(df)
        return out.withColumn(name, self._ml_cate()).select(*df.columns, name)


class Fitted:
    """A model of MLlib's (a class such as GBTRegressor, with its parameters), fitted on columns. A classifier's prediction is its probability of 1."""

    def __init__(self, df: DataFrame, y: Column, x: list[Column], base_model: type, params: dict):
        from pyspark.ml.feature import VectorAssembler

        self.assembler = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(x))], outputCol="__features", handleInvalid="skip")
        rows = df.select(y.cast("double").alias("__label"), *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(x)]).na.drop()
        self.model = base_model(featuresCol="__features", labelCol="__label", predictionCol="__prediction", **params).fit(self.assembler.transform(rows))

    def add(self, df: DataFrame, name: str, x: list[Column]) -> DataFrame:
        """The rows with the prediction for these features; null where a feature is null."""
        from pyspark.ml.functions import vector_to_array

        full = df.withColumns({f"__x{i}": c.cast("double") for i, c in enumerate(x)})
        known = F.lit(True)
        for i in range(len(x)):
            known = known & F.col(f"__x{i}").isNotNull()
        filled = full.withColumn("__known", known).na.fill(0.0, [f"__x{i}" for i in range(len(x))])
        out = self.model.transform(self.assembler.setHandleInvalid("keep").transform(filled))
        value = vector_to_array("probability")[1] if "probability" in out.columns and "probability" not in df.columns else F.col("__prediction")
        return out.withColumn(name, F.when(F.col("__known"), value)).select(*df.columns, name)


class SLearner(_Learner):
    def _with_outcomes(self, df: DataFrame) -> DataFrame:
        out = self.model.add(df, "__m0", self._features(F.lit(0.0)))
        return self.model.add(out, "__m1", self._features(F.lit(1.0)))

    def _ml_cate(self) -> Column:
        return F.col("__m1") - F.col("__m0")

    def fit(self, df: DataFrame) -> SLearner:
        if self.base_model is not None:
            self.model = Fitted(df, expr_of(self.y), self._features(expr_of(self.t)), self.base_model, self.params)
            return self
        self.model = fit_ols(df, Formula(self.y, [*self.x, f"({self.t})", *[f"({self.t}) * ({c})" for c in self.x]]))
        return self

    def _cate(self) -> Column:
        b = np.nan_to_num(self.model.coef)
        k = len(self.x)
        out = F.lit(float(b[k]))
        for v, c in zip(b[k + 1 : -1], self.x, strict=True):
            out = out + float(v) * expr_of(c)
        return out


class TLearner(_Learner):
    def _with_outcomes(self, df: DataFrame) -> DataFrame:
        return self.models[1].add(self.models[0].add(df, "__m0", self._features()), "__m1", self._features())

    def _ml_cate(self) -> Column:
        return F.col("__m1") - F.col("__m0")

    def fit(self, df: DataFrame) -> TLearner:
        if self.base_model is not None:
            self.models = [Fitted(self._arm(df, a), expr_of(self.y), self._features(), self.base_model, self.params) for a in (0, 1)]
            return self
        self.models = [fit_ols(self._arm(df, a), Formula(self.y, self.x)) for a in (0, 1)]
        return self

    def _cate(self) -> Column:
        return self.models[1].predict() - self.models[0].predict()


class XLearner(TLearner):
    """Effects imputed by the other arm's model are modelled in each arm and averaged, half and half."""

    def _with_outcomes(self, df: DataFrame) -> DataFrame:
        return self.effects[1].add(self.effects[0].add(df, "__m0", self._features()), "__m1", self._features())

    def _ml_cate(self) -> Column:
        return 0.5 * F.col("__m0") + 0.5 * F.col("__m1")

    def fit(self, df: DataFrame) -> XLearner:
        super().fit(df)
        if self.base_model is not None:
            known = TLearner._with_outcomes(self, df)
            gaps = {0: F.col("__m1") - expr_of(self.y), 1: expr_of(self.y) - F.col("__m0")}
            self.effects = [Fitted(self._arm(known, a), gap, self._features(), self.base_model, self.params) for a, gap in gaps.items()]
            return self
        d1 = self._arm(df, 1).withColumn("__d", expr_of(self.y) - self.models[0].predict())
        d0 = self._arm(df, 0).withColumn("__d", self.models[1].predict() - expr_of(self.y))
        self.effects = [fit_ols(d, Formula("__d", self.x)) for d in (d0, d1)]
        return self

    def _cate(self) -> Column:
        return 0.5 * self.effects[0].predict() + 0.5 * self.effects[1].predict()


class TransformedOutcome(_Learner):
    """y / p for the treated and -y / (1 - p) for the others, regressed on x."""

    def _with_outcomes(self, df: DataFrame) -> DataFrame:
        return self.model.add(df, "__m", self._features())

    def _ml_cate(self) -> Column:
        return F.col("__m")

    def fit(self, df: DataFrame) -> TransformedOutcome:
        p = expr_of(self.p) if isinstance(self.p, str) else F.lit(float(self.p))
        z = F.when(expr_of(self.t) == 1, expr_of(self.y) / p).otherwise(-expr_of(self.y) / (1 - p))
        if self.base_model is not None:
            self.model = Fitted(df, z, self._features(), self.base_model, self.params)
            return self
        self.model = fit_ols(df.withColumn("__z", z), Formula("__z", self.x))
        return self

    def _cate(self) -> Column:
        return self.model.predict()


class ClassVariableTransformation(_Learner):
    """For a binary outcome: whether it agrees with the arm is modelled; uplift is 2 p - 1."""

    def _with_outcomes(self, df: DataFrame) -> DataFrame:
        return self.model.add(df, "__m", self._features())

    def _ml_cate(self) -> Column:
        return 2 * F.col("__m") - 1

    def fit(self, df: DataFrame) -> ClassVariableTransformation:
        from .regression import Logistic

        agrees = F.when(expr_of(self.y) == expr_of(self.t), 1.0).otherwise(0.0)
        if self.base_model is not None:
            self.model = Fitted(df, agrees, self._features(), self.base_model, self.params)
            return self
        self.model = Logistic(iterations=50).fit("__z", self.x, df.withColumn("__z", agrees))
        return self

    def _cate(self) -> Column:
        return 2 * self.model.probability() - 1


class Propensity(_Learner):
    def _with_outcomes(self, df: DataFrame) -> DataFrame:
        return self.model.add(df, "__m", self._features())

    def _ml_cate(self) -> Column:
        return F.col("__m")

    def fit(self, df: DataFrame) -> Propensity:
        from .regression import Logistic

        if self.base_model is not None:
            self.model = Fitted(df, expr_of(self.t), self._features(), self.base_model, self.params)
            return self
        self.model = Logistic(iterations=50).fit(self.t, self.x, df)
        return self

    def _cate(self) -> Column:
        return self.model.probability()


class Retrospective(Propensity):
    """The propensity among rows with a positive outcome."""

    def fit(self, df: DataFrame) -> Retrospective:
        super().fit(df.where(expr_of(self.y) > 0))
        return self


# Evaluation

_METRICS = {
    "ate": lambda c: F.try_divide(c["y1"], c["n1"]) - F.try_divide(c["y0"], c["n0"]),
    "roi": lambda c: F.try_divide(c["b1"] + c["b0"], c["k1"] + c["k0"]),
    "iroi": lambda c: F.try_divide(F.try_divide(c["b1"], c["n1"]) - F.try_divide(c["b0"], c["n0"]), F.try_divide(c["k1"], c["n1"]) - F.try_divide(c["k0"], c["n0"])),
    "target_rate": lambda c: F.try_divide(c["y1"] + c["y0"], c["n1"] + c["n0"]),
}


def assign_bucket(df: DataFrame, score: str, n_buckets: int = 30, name: str = "bucket") -> DataFrame:
    """Buckets of near-equal size by the quantiles of a score, from 1 for the lowest."""
    levels = [i / n_buckets for i in range(1, n_buckets)]
    cuts = sorted(set(df.agg(F.percentile_approx(expr_of(score), F.array(*map(F.lit, levels)), F.lit(10_000))).first()[0] or []))
    return df.withColumn(name, sum((F.when(expr_of(score) > c, 1).otherwise(0) for c in cuts), F.lit(1)).cast("long"))


def estimate(
    df: DataFrame, metric: str, *, target: str = "outcome", benefit: str = "revenue", cost: str = "cost", treatment: str = "treatment", treatment_value=1, control_value=0, bucket: str | None = None, cumulative: bool = False, n_bootstraps: int = 0, key: str | None = None, alpha: float = 0.05, seed: int = 0
) -> DataFrame:
    """A metric (ate, roi, iroi, target_rate), by bucket or cumulatively from the highest bucket, with a reverse-percentile interval from Poisson weights.

    All replicates come from one aggregation of weighted sums; the replicates of a bucket are a small array.
    """
    t = F.expr(treatment)
    sums = {"y": expr_of(target) if metric in ("ate", "target_rate") else F.lit(0.0), "b": expr_of(benefit) if "roi" in metric else F.lit(0.0), "k": expr_of(cost) if "roi" in metric else F.lit(0.0)}
    arm = F.when(t == F.lit(treatment_value), 1).when(t == F.lit(control_value), 0)
    if n_bootstraps and not key:
        raise ValueError("a bootstrap needs a key that tells rows apart")
    by = [arm, *([F.col(bucket)] if bucket else [])]
    if n_bootstraps:
        per = weighted_sums(df, list(sums.values()), F.lit(1.0), key, range(n_bootstraps + 1), 1.0, seed, by, point=True)
    else:
        named = [v.alias(f"__v{i}") for i, v in enumerate(sums.values())]
        per = df.select(*named, *[c.alias(f"g{i}") for i, c in enumerate(by)]).groupBy("g0", *(["g1"] if bucket else [])).agg(F.count("*").cast("double").alias("w"), *[F.sum(f"__v{i}").alias(f"s{i}") for i in range(3)]).withColumn("replicate", F.lit(0))
    names = {name: [F.max(F.when(F.col("g0") == a, F.col(c))).alias(f"{name}{a}") for a in (1, 0)] for name, c in (("n", "w"), ("y", "s0"), ("b", "s1"), ("k", "s2"))}
    wide = per.groupBy("replicate", *([F.col("g1").alias(bucket)] if bucket else [])).agg(*[c for cs in names.values() for c in cs]).fillna(0.0)
    if cumulative:
        w = Window.partitionBy("replicate").orderBy(F.col(bucket).desc()).rowsBetween(Window.unboundedPreceding, 0)  # as many rows as buckets
        wide = wide.select("replicate", bucket, *[F.sum(f"{c}{a}").over(w).alias(f"{c}{a}") for c in names for a in (1, 0)])
    point = lambda c: F.max(F.when(F.col("replicate") == 0, c))
    value = _METRICS[metric]({f"{c}{a}": F.col(f"{c}{a}") for c in names for a in (1, 0)})
    valued = wide.withColumn("__value", value)
    grouped = valued.groupBy(bucket) if bucket else valued.groupBy()
    spread = [F.sort_array(F.collect_list(F.when(F.col("replicate") > 0, F.col("__value")))).alias("__r")] if n_bootstraps else []
    out = grouped.agg(point(F.col("__value")).alias(metric), point(F.col("n1")).alias("n_treated"), point(F.col("n0")).alias("n_control"), *spread)
    if not n_bootstraps:
        return out
    at = lambda p: F.get("__r", F.least(F.size("__r") - 1, F.floor(p * F.size("__r"))).cast("int"))
    mean = F.aggregate("__r", F.lit(0.0), lambda a, v: a + v) / n_bootstraps
    var = F.aggregate("__r", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / max(n_bootstraps - 1, 1)
    return out.withColumns({"std_error": F.sqrt(var), "lower": 2 * F.col(metric) - at(1 - alpha / 2), "upper": 2 * F.col(metric) - at(alpha / 2)}).drop("__r")


def estimate_per_quantile(df: DataFrame, metric: str, *, score: str, n_buckets: int = 30, **how) -> DataFrame:
    return estimate(assign_bucket(df, score, n_buckets), metric, bucket="bucket", **how)


def estimate_cate_lift(df: DataFrame, *, score: str, n_buckets: int = 30, **how) -> DataFrame:
    """The effect among the highest buckets over the effect among all."""
    c = estimate(assign_bucket(df, score, n_buckets), "ate", bucket="bucket", cumulative=True, **how)
    whole = F.last("ate").over(Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return c.withColumn("lift", F.try_divide("ate", whole))


def estimate_qini(df: DataFrame, *, score: str, n_buckets: int = 30, **how) -> DataFrame:
    """The Qini curve: the effect among the highest buckets times their share, beside that of a random order."""
    c = estimate(assign_bucket(df, score, n_buckets), "ate", bucket="bucket", cumulative=True, **how)
    w = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.col("n_treated") + F.col("n_control")
    c = c.withColumn("fraction", n / F.max(n).over(w)).withColumn("whole", F.last("ate").over(w))
    return c.select("bucket", "fraction", (F.col("ate") * F.col("fraction")).alias("qini"), (F.col("whole") * F.col("fraction")).alias("random"))


def compute_auuc(qini: DataFrame) -> float:
    """The area under a Qini curve, by trapezoids from 0."""
    x, y, _ = _points(qini)
    return float(np.sum((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2))


def compute_qini_coefficient(qini: DataFrame) -> float:
    x, _, r = _points(qini)
    return compute_auuc(qini) - float(np.sum((x[1:] - x[:-1]) * (r[1:] + r[:-1]) / 2))


def _points(qini: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = sorted((r["fraction"], r["qini"] or 0.0, r["random"] or 0.0) for r in qini.collect())
    return tuple(np.array([0.0, *[r[i] for r in rows]]) for i in range(3))


def simulate_randomized_trial(spark, n: int = 1000, p: int = 5, sigma: float = 1.0, binary_outcome: bool = False, add_cost_benefit: bool = False, seed: int = 0) -> DataFrame:
    """A synthetic trial: covariates x0.. on (0, 1), a coin-flip treatment, an effect of (x0 + x1) / 2, and noise. Generated where it is used."""
    base = spark.range(n).withColumnRenamed("id", "unit")
    u = lambda k: uniform(seed, F.col("unit"), k, "trial")
    df = base.withColumns({f"x{i}": u(i) for i in range(p)})
    df = df.withColumn("treatment", (u(1000) < 0.5).cast("int")).withColumn("tau", (F.col("x0") + F.col("x1")) / 2)
    noise = F.sqrt(-2 * F.log(u(1001))) * F.cos(2 * math.pi * u(1002))
    value = F.sin(math.pi * F.col("x0") * F.col("x1")) + F.col("tau") * F.col("treatment") + sigma * noise
    df = df.withColumn("outcome", (u(1003) < 1 / (1 + F.exp(-value))).cast("double") if binary_outcome else value)
    if add_cost_benefit:
        df = df.withColumn("revenue", F.abs("outcome") * 10).withColumn("cost", 1 + F.col("treatment") * u(1004))
    return df
