"""Bootstrap and permutation inference with weights instead of copied rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .hypothesis import Metric
from .moments import MeanFunction, expr_of, finish, moment_columns, moments_of


def uniform(seed: int, key: Column, replicate: Column | int, use: str = "") -> Column:
    """A number in (0, 1) that the key, seed, replicate and ``use`` fix, whatever the partitioning. Different uses are independent."""
    h = F.xxhash64(key, F.lit(seed), F.lit(replicate) if isinstance(replicate, int) else replicate, F.lit(use))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def poisson_weight(u: Column, rate: float = 1.0) -> Column:
    """A Poisson count from a uniform number, by inversion up to a count that is practically never reached."""
    p = c = math.exp(-rate)
    out = F.when(u <= c, 0)
    for k in range(1, 12 + int(6 * rate)):
        p *= rate / k
        c += p
        out = out.when(u <= c, k)
    return out.otherwise(12 + int(6 * rate))


def boot_strap(df: DataFrame, expression: str, key: str, *, resample_frac: float = 1.0, n_resamples: int = 100, seed: int = 0) -> DataFrame:
    """Replicates of a function of means (or of sums, ``sum(a) / sum(b)``): replicate, value.

    Every row has a Poisson weight in each replicate, a function of ``key``, so that one pass makes all replicates and nothing is copied. The total
    of weights is random, unlike in a multinomial draw; divide by means where that matters. n_resamples is 1 to 10,000.
    """
    if not 1 <= n_resamples <= 10_000:
        raise ValueError("n_resamples must be between 1 and 10,000")
    total = "sum(" in expression
    f = MeanFunction(expression.replace("sum(", "avg("))
    k = len(f.args)
    sums = weighted_sums(df, f.columns(), F.lit(1.0), key, range(n_resamples), resample_frac, seed)

    def one(row):
        w = row["w"] or 0
        s = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
        return [(f(s if total else s / w).value if w else None,)]

    return finish(sums, one, "value double", ["replicate"])


def boot_strap_multi(df: DataFrame, expressions: list[str], key: str, *, resample_frac: float = 1.0, n_resamples: int = 100, seed: int = 0) -> DataFrame:
    """Replicates of several functions of means from the same weights, in one pass: replicate, values."""
    fs = [MeanFunction(e) for e in expressions]
    args: list[str] = []
    for f in fs:
        args += [a for a in f.args if a not in args]
    where = [[args.index(a) for a in f.args] for f in fs]
    sums = weighted_sums(df, [expr_of(a) for a in args], F.lit(1.0), key, range(n_resamples), resample_frac, seed)

    def one(row):
        w = row["w"] or 0
        means = np.array([(row[f"s{i}"] or 0.0) / w if w else math.nan for i in range(len(args))])
        return [([float(f(means[i]).value) for f, i in zip(fs, where, strict=True)],)]

    return finish(sums, one, "values array<double>", ["replicate"])


def boot_strap_ols(df: DataFrame, formula: str, key: str, *, resample_frac: float = 1.0, n_resamples: int = 100, seed: int = 0) -> DataFrame:
    """Replicates of the coefficients of a linear model: replicate, coef (in the order of the terms, the intercept last)."""
    from .regression import Formula, _values, weighted_from_row

    f = Formula.parse(formula)
    values = _values(f)
    rows = replicated(df.select(F.expr(key).alias("__key"), *[v.alias(f"__v{i}") for i, v in enumerate(values)]), range(n_resamples))
    count = poisson_weight(F.col("__u"), resample_frac).cast("double")
    stats = rows.withColumn("__u", uniform(seed, F.col("__key"), F.col("replicate"), "bootstrap")).withColumn("__n", count).where("__n > 0").groupBy("replicate").agg(*moment_columns([F.col(f"__v{i}") for i in range(len(values))], F.col("__n")))
    return finish(stats, lambda row: [([float(b) for b in weighted_from_row(row, f).coef],)], "coef array<double>", ["replicate"])


def replicated(df: DataFrame, replicates: range) -> DataFrame:
    """Every row once for each replicate, for an aggregation by replicate: rows are summed where they are, so only a row for each replicate and task is shuffled."""
    ids = F.sequence(F.lit(replicates.start), F.lit(replicates.stop - 1))
    return df.withColumn("replicate", F.explode(ids))


_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
#: Rows that are drawn for at a time, so that the work stays in the processor's cache.
_CHUNK = 8192


def _hash_on(h: np.ndarray, replicate: int, use: bytes) -> np.ndarray:
    """xxhash64(..., replicate, use) of Spark from ``h``, the hash of what stands before."""
    p1, p2, p3, p4, p5 = _PRIMES
    v, tmp = np.empty_like(h), np.empty_like(h)

    def rotate(r: int) -> None:
        np.right_shift(v, np.uint64(64 - r), out=tmp)
        np.left_shift(v, np.uint64(r), out=v)
        np.bitwise_or(v, tmp, out=v)

    def mixed(x: int) -> np.uint64:
        return np.uint64(x & 0xFFFFFFFFFFFFFFFF)

    def word(x: int, bytes_: int) -> None:
        if bytes_ == 8:
            k = x * int(p2) & 0xFFFFFFFFFFFFFFFF
            np.bitwise_xor(v, mixed((k << 31 | k >> 33) * int(p1)), out=v)
            r, m, plus = 27, p1, p4
        elif bytes_ == 4:
            np.bitwise_xor(v, mixed(x * int(p1)), out=v)
            r, m, plus = 23, p2, p3
        else:
            np.bitwise_xor(v, mixed(x * int(p5)), out=v)
            r, m, plus = 11, p1, None
        rotate(r)
        np.multiply(v, m, out=v)
        if plus is not None:
            np.add(v, plus, out=v)

    def finished() -> None:
        for shift, prime in ((33, p2), (29, p3), (32, None)):
            np.right_shift(v, np.uint64(shift), out=tmp)
            np.bitwise_xor(v, tmp, out=v)
            if prime is not None:
                np.multiply(v, prime, out=v)

    np.add(h, mixed(int(p5) + 4), out=v)
    word(replicate & 0xFFFFFFFF, 4)
    finished()
    np.add(v, mixed(int(p5) + len(use)), out=v)
    at = 0
    while at < len(use):
        step = next(n for n in (8, 4, 1) if at + n <= len(use))
        word(int.from_bytes(use[at : at + step], "little"), step)
        at += step
    finished()
    return v


def _limits(rate: float) -> tuple[int, list[np.uint64]]:
    """A Poisson count as ``poisson_weight(uniform(...))`` has it: a fixed number, and one for each of these bounds that the hash is above."""
    p = c = math.exp(-rate)
    least, bounds = 0, []
    for k in range(12 + int(6 * rate)):
        if k:
            p *= rate / k
            c += p
        lo, hi = -1, (1 << 53) - 1  # the largest number of 53 bits whose uniform number is at most c
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if (float(mid) + 0.5) / float(1 << 53) <= c else (lo, mid - 1)
        if lo < 0:
            least += 1
        else:
            bounds.append(np.uint64(lo << 11 | 0x7FF))
    return least, bounds


def _codes(columns: list) -> tuple[np.ndarray, list[int]]:
    """For each row the number of its group among rows equal in all columns (null is a value), and a row of each group."""
    code = np.zeros(len(columns[0]) if columns else 0, np.int64)
    for c in columns:
        own = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first.tolist()


def weighted_sums(df: DataFrame, values: list[Column], weight: Column, key: str, replicates: range, rate: float, seed: int, by: list[Column] = (), point: bool = False) -> DataFrame:
    """By replicate (and ``by``) the sums of w and w x, w the row's weight times a Poisson count; with ``point``, replicate 0 counts each row once.

    Counts are those of ``poisson_weight(uniform(...))``. A row's hash of key and seed comes from Spark; its replicates are drawn by numpy, many rows at once, and
    summed where the rows are, so that no row is copied.
    """
    k, g = len(values), len(by)
    rows = df.select(F.xxhash64(F.expr(key), F.lit(seed)).alias("__h"), weight.cast("double").alias("__w"), *[v.cast("double").alias(f"__v{i}") for i, v in enumerate(values)], *[c.alias(f"g{i}") for i, c in enumerate(by)])
    schema = StructType([StructField("replicate", IntegerType()), *[rows.schema[f"g{i}"] for i in range(g)], *[StructField(n, DoubleType()) for n in ("w", *[f"s{i}" for i in range(k)])]])

    def sums(batches):
        import pyarrow as pa

        least, bounds = _limits(rate)
        total: dict = {}  # by group: sums, and whether a number was summed, by replicate and column
        scalars: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            column = lambda n: batch.column(names.index(n))  # noqa: B023, E731
            h = column("__h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            w = column("__w").fill_null(0.0).to_numpy(zero_copy_only=False)
            known = [column("__w").is_valid().to_numpy(zero_copy_only=False)]
            x = [w]
            for i in range(k):
                known.append(known[0] & column(f"__v{i}").is_valid().to_numpy(zero_copy_only=False))
                with np.errstate(invalid="ignore", over="ignore"):
                    x.append(np.where(known[-1], w * column(f"__v{i}").fill_null(0.0).to_numpy(zero_copy_only=False), 0.0))
            x, known = np.column_stack(x), np.column_stack(known)
            groups = [column(f"g{i}") for i in range(g)]
            code, first = _codes(groups) if g else (np.zeros(len(h), np.int64), [0])
            for c, row in enumerate(first):
                group = tuple(col[row].as_py() for col in groups)
                scalars.setdefault(group, [col[row] for col in groups])
                s, seen = total.setdefault(group, (np.zeros((len(replicates), k + 1)), np.zeros((len(replicates), k + 1), bool)))
                own = np.flatnonzero(code == c) if len(first) > 1 else np.arange(len(h))
                for at in range(0, len(own), _CHUNK):
                    part = own[at : at + _CHUNK]
                    hp, xp, kp = h[part], x[part], known[part]
                    finite, whole = np.isfinite(xp).all(), kp.all()
                    for j, r in enumerate(replicates):
                        if point and r == 0:
                            n = np.ones(len(hp))
                        else:
                            u = _hash_on(hp, r, b"bootstrap")
                            top, count = u.max(), np.full(len(u), least, np.uint8 if len(bounds) + least < 256 else np.int32)
                            for b in bounds:
                                if top <= b:
                                    break
                                count += (u > b).view(np.uint8)
                            n = count.astype(float)
                        # 0 times infinity isn't 0, and rows that aren't drawn don't count.
                        s[j] += n @ xp if finite else (n[n > 0] @ xp[n > 0])
                        if whole:
                            seen[j] |= bool(n.any())
                        elif not seen[j].all():
                            seen[j] |= kp[n > 0].any(0)
        for group, (s, seen) in total.items():
            drawn = seen.any(1)
            m = int(drawn.sum())
            if not m:
                continue
            out = [pa.array(np.array(replicates, np.int32)[drawn], pa.int32())]
            out += [pa.array([v.as_py()] * m, v.type) for v in scalars[group]]
            out += [pa.array(s[drawn, i], pa.float64(), mask=~seen[drawn, i]) for i in range(k + 1)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    parts = rows.mapInArrow(sums, schema)
    return parts.groupBy("replicate", *[f"g{i}" for i in range(g)]).agg(F.sum("w").alias("w"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])


def permutation(df: DataFrame, y: str, index: str, key: str, *, permutation_num: int = 100, mde: float = 0.0, mde_type: int = 1, scheme: str = "shuffle", statistic: str = "diff", seed: int = 0) -> DataFrame:
    """Statistics under relabelled arms: replicate, value (difference of metric, or its t).

    ``shuffle``: labels keep their counts in expectation, each row being treated if a uniform number of its key falls below the observed
    share; ``bernoulli``: with chance one half. ``mde`` is added to the treated (type 0) or multiplies them by 1 + mde (type 1).
    """
    if not 1 <= permutation_num <= 100_000:
        raise ValueError("permutation_num must be between 1 and 100,000")
    metric = Metric(y)
    share = 0.5 if scheme == "bernoulli" else df.agg(F.avg(F.expr(index).cast("double"))).first()[0] or 0.5
    k = len(metric.args)
    rows = replicated(df.select(F.expr(key).alias("__key"), *[c.alias(f"__v{i}") for i, c in enumerate(metric.columns())]), range(permutation_num))
    rows = rows.withColumn("arm", (uniform(seed, F.col("__key"), F.col("replicate"), "permutation") < share).cast("int"))
    values = [F.col(f"__v{i}") for i in range(k)]
    if mde:  # the metric's first variable is what the treatment moves
        values[0] = F.when(F.col("arm") == 1, values[0] + mde if mde_type == 0 else values[0] * (1 + mde)).otherwise(values[0])
    stats = rows.groupBy("replicate", "arm").agg(*moment_columns(values))
    both = stats.groupBy("replicate").agg(F.collect_list(F.struct(*[c for c in stats.columns if c != "replicate"])).alias("arms"))

    def one(row):
        parts = {a["arm"]: moments_of(a, k) for a in row["arms"]}
        if len(parts) < 2 or min(p.n for p in parts.values()) < 2:
            return [(None,)]
        (v0, c0), (v1, c1) = metric.at(parts[0]), metric.at(parts[1])
        gap = float(v1[0] - v0[0])
        return [(gap if statistic == "diff" else gap / math.sqrt(c0[0, 0] + c1[0, 0]),)]

    return finish(both, one, "value double", ["replicate"])


def _effect(df: DataFrame, y: str, t: str, weight: Column, key: str, n: int, seed: int) -> DataFrame:
    """Replicates of the difference of weighted means."""
    sums = weighted_sums(df, [expr_of(y)], weight, key, range(n + 1), 1.0, seed, [(expr_of(t) > 0).cast("int")], point=True)
    mean = lambda arm: F.max(F.when(F.col("g0") == arm, F.try_divide("s0", "w")))
    return sums.groupBy("replicate").agg((mean(1) - mean(0)).alias("value"))


def _summary(replicates: DataFrame) -> DataFrame:
    point = F.max(F.when(F.col("replicate") == 0, F.col("value")))
    rest = F.when(F.col("replicate") > 0, F.col("value"))
    s = replicates.agg(point.alias("effect"), F.stddev_samp(rest).alias("std"), F.count(rest).alias("replicates"))
    return s.select("effect", "std", (F.col("effect") / F.nullif("std", F.lit(0.0))).alias("t_statistic"), (F.col("effect") - 1.96 * F.col("std")).alias("lower"), (F.col("effect") + 1.96 * F.col("std")).alias("upper"), "replicates")


def ate_estimator(df: DataFrame, y: str, t: str, key: str, B: int = 500, seed: int = 0) -> DataFrame:
    """The difference of means with a bootstrap standard deviation."""
    return _summary(_effect(df, y, t, F.lit(1.0), key, B, seed))


def ipw_estimator(df: DataFrame, y: str, t: str, p: str, key: str, B: int = 500, seed: int = 0, smooth: float = 0.01) -> DataFrame:
    """The inverse-propensity difference of means; ``smooth`` is added to propensities against division by nearly zero."""
    score = expr_of(p)
    weight = F.when(expr_of(t) > 0, 1 / (score + smooth)).otherwise(1 / (1 - score + smooth))
    return _summary(_effect(df, y, t, weight, key, B, seed))


def quantile_test_bucket(df: DataFrame, y: str, index: str, levels: list[float], uin: str, *, buckets: int = 64, alpha: float = 0.05) -> DataFrame:
    """Treatment effects on quantiles; their error from the spread of the quantiles of hashed buckets of units."""
    from ..functions.distributions import norm_cdf, norm_ppf

    arm, bucket = F.expr(index).cast("int").alias("arm"), F.pmod(F.xxhash64(F.expr(uin).cast("string")), F.lit(buckets)).alias("bucket")
    rows = df.select(arm, bucket, expr_of(y).alias("v")).where("arm in (0, 1) and v is not null")
    q = F.percentile_approx("v", F.array(*map(F.lit, levels)), F.lit(10_000)).alias("q")
    per = rows.groupBy("arm", "bucket").agg(q).select("arm", F.posexplode("q").alias("i", "v")).groupBy("arm", "i").agg(F.var_samp("v").alias("var"), F.count("*").alias("k"))
    whole = rows.groupBy("arm").agg(q).select("arm", F.posexplode("q").alias("i", "v"))
    both = whole.join(per, ["arm", "i"]).groupBy("i").agg(*[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}{a}") for a in (0, 1) for c in ("v", "var", "k")])

    def one(row):
        if row["v0"] is None or row["v1"] is None:
            return []
        se = math.sqrt((row["var0"] or 0) / row["k0"] + (row["var1"] or 0) / row["k1"])
        gap, z = row["v1"] - row["v0"], norm_ppf(1 - alpha / 2)
        p = 2 * norm_cdf(-abs(gap) / se) if se > 0 else float(gap == 0)
        return [(float(levels[int(row["i"])]), row["v0"], row["v1"], gap, se, p, gap - z * se, gap + z * se)]

    return finish(both, one, "level double,quantile0 double,quantile1 double,effect double,stderr double,p_value double,lower double,upper double", [])

