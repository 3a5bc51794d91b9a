"""Running sums over all rows in the order of a column, without bringing them into one task."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most; a range is the work of one task.
MOST = 4096


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder ``spark.checkpoint.dir`` and read back: what isn't fixed by values, such as partition numbers, is fixed from now on.

    Where the setting is missing, a temporary folder serves in local mode; on a cluster that is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="effectum-")
    path = f"{folder.rstrip('/')}/effectum/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_bounds(df: DataFrame, order: str) -> list:
    """Values that cut ``order`` into about as many ranges of near-equal numbers of rows as there are shuffle partitions: approximate quantiles, one aggregation.

    Whatever they are, sums by range are right; poor ones only make the ranges uneven.
    """
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST)
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
    return sorted({b for b in found or [] if b == b})


def exact_quantiles(df: DataFrame, column: str, levels: list[float], accuracy: int = 10_000) -> list:
    """Exact quantiles of a number, between two values by their distance, as ``percentile`` has them, without all values in one task; null where there are no values.

    Approximate quantiles bracket each level; a second aggregation counts what lies below the brackets, and only distinct values within them, a few
    thousandths of the rows, reach the driver. A bracket that misses its level is widened, at last to all values.
    """
    rows = df.select(F.expr(column).cast("double").alias("v")).where("v is not null")
    within = 2 / accuracy
    while True:
        shares = [s for p in levels for s in (max(p - within, 0.0), min(p + within, 1.0))]
        r = rows.agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile_approx("v", F.array(*map(F.lit, shares)), F.lit(accuracy)).alias("q")).first()
        n = r["n"]
        if not n:
            return [None] * len(levels)
        at = [(math.floor((n - 1) * p), math.ceil((n - 1) * p)) for p in levels]
        # The ends are known; other brackets reach the ends where their share does.
        ends = [i for i, (a, b) in enumerate(at) if b == 0 or a == n - 1]
        brackets = {i: (r["min"] if shares[2 * i] <= 0 else r["q"][2 * i], r["max"] if shares[2 * i + 1] >= 1 else r["q"][2 * i + 1]) for i in range(len(levels)) if i not in ends}
        out = {i: r["min"] if at[i][1] == 0 else r["max"] for i in ends}
        if not brackets:
            break
        inside = F.lit(False)
        for lo, hi in brackets.values():
            inside = inside | F.col("v").between(lo, hi)
        below = rows.agg(*[F.count_if(F.col("v") < lo).alias(f"b{i}") for i, (lo, _) in brackets.items()], *[F.count_if(F.col("v") <= hi).alias(f"e{i}") for i, (_, hi) in brackets.items()]).first()
        if any(not below[f"b{i}"] <= at[i][0] <= at[i][1] < below[f"e{i}"] for i in brackets):
            within *= 10
            continue
        found = rows.where(inside).groupBy("v").agg(F.count("*").alias("n")).toPandas().sort_values("v")
        v, count = found["v"].to_numpy(float), found["n"].to_numpy()
        for i, (lo, _) in brackets.items():
            start = np.searchsorted(v, lo)
            reach = below[f"b{i}"] + np.cumsum(count[start:])
            a, b = (float(v[start + np.searchsorted(reach, k, "right")]) for k in at[i])
            place = (n - 1) * levels[i]
            out[i] = a if a == b else (at[i][1] - place) * a + (place - at[i][0]) * b
        break
    return [out[i] for i in range(len(levels))]


def with_range(df: DataFrame, order: str, bounds: list, name: str) -> DataFrame:
    """The rows with the number of the bounds below their value: it follows from the value alone, so any two plans agree on it.

    A binary search in a constant array; each step is a projection of its own.
    """
    if not bounds:
        return df.withColumn(name, F.lit(0))
    known = F.array(*[F.lit(b) for b in bounds])
    step = 1 << (len(bounds).bit_length() - 1)
    at: Column = F.when(F.get(known, F.lit(step - 1)) < F.col(order), step).otherwise(0)
    out = df.withColumn(name, at)
    while step > 1:
        step //= 2
        further = F.get(known, F.col(name) + (step - 1)) < F.col(order)
        out = out.withColumn(name, F.col(name) + F.when(further, step).otherwise(0))
    return out


def running(rows: DataFrame, order: str, sums: list[str], bounds: list | None = None) -> DataFrame:
    """Running sums of columns over all rows by ``order`` (distinct values, not null), as cum_<name> (with the row itself).

    Each range of values is summed up by itself and adds the totals of those before it; these, a row for each range, are
    broadcast. So no task sees all rows, and results don't depend on how rows are partitioned.
    """
    cuts = range_bounds(rows, order) if bounds is None else bounds
    ranged = with_range(rows, order, cuts, "__p")
    totals = ranged.groupBy("__p").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__p", *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__b_{s}") for s in sums])
    own = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"cum_{s}": F.sum(s).over(own) for s in sums}).join(F.broadcast(totals), "__p")
    return out.select(*rows.columns, *[(F.col(f"cum_{s}") + F.col(f"__b_{s}")).alias(f"cum_{s}") for s in sums])
