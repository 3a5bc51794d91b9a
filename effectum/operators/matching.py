"""Matching on scores and labels, and balance of covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from .moments import expr_of
from .ranges import kept, range_bounds, with_range
from .regression import Formula, LinearModel, fit_ols


def _match(df: DataFrame, treatment: str, keys: list[Column], order: list[str], k: int, name: str) -> DataFrame:
    """Match within cells of equal keys: quota treated rows, each with up to k controls; the index counts on over the cells.

    Rows are numbered within a cell and arm in the given order, which fixes the result. A cell's quota and the number of matches
    in cells before it come from a table of one row a cell.
    """
    cells = [f"__k{i}" for i in range(len(keys))]
    base = df.withColumns({c: v for c, v in zip(cells, keys, strict=True)}).withColumn("__t", (expr_of(treatment) > 0).cast("int"))
    usable = base.where(F.concat_ws("", *[F.when(F.col(c).isNull(), F.lit("x")) for c in cells], F.when(F.col("__t").isNull(), F.lit("x"))) == "")
    sizes = usable.groupBy(*cells).agg(F.count_if(F.col("__t") == 1).alias("__n1"), F.count_if(F.col("__t") == 0).alias("__n0")).where("__n1 > 0 and __n0 > 0")
    sizes = sizes.withColumn("__q", F.least("__n1", "__n0"))
    # The offset of a cell: range partitions of the cell table are summed up one by one. They are kept, as both plans below must see the same ranges.
    ranged = kept(sizes.repartitionByRange(*cells).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy("__p").agg(F.sum("__q").alias("__s"))
    before = totals.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.coalesce(F.sum("__q").over(Window.partitionBy("__p").orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.withColumn("__o", own).join(F.broadcast(before), "__p").select(*cells, "__q", (F.col("__o") + F.col("__b")).alias("__o"))
    # A cell and arm may hold most rows, so they are numbered by ranges of the first column of the order, after the counts of the ranges before.
    first = base.withColumn("__f", F.expr(order[0]))
    ordered = isinstance(first.schema["__f"].dataType, NumericType | DateType | TimestampType)
    ranged = with_range(first, "__f", range_bounds(first, "__f") if ordered else [], "__r").drop("__f")
    groups = [*cells, "__t", "__r"]
    earlier = Window.partitionBy(*cells, "__t").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*groups).agg(F.count("*").alias("__c")).withColumn("__c", F.coalesce(F.sum("__c").over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*[F.expr(o) for o in order]))
    placed = ranged.withColumn("__rn", place).join(counts, groups, "left").withColumn("__rn", F.col("__rn") + F.col("__c"))
    numbered = placed.join(offsets, cells, "left")
    q = F.col("__q")
    index = F.when((F.col("__t") == 1) & (F.col("__rn") <= q), F.col("__o") + F.col("__rn")).when((F.col("__t") == 0) & (F.col("__rn") <= q * k), -(F.col("__o") + (F.col("__rn") - 1) % q + 1))
    out = numbered.withColumn(name, F.coalesce(index, F.lit(0)).cast("long"))
    return out.select(*df.columns, name)


def caliper_matching(df: DataFrame, treatment: str, score: str, caliper: float = 0.2, *, exacts: list[str] = (), order: list[str], k: int = 1, name: str = "matching_index") -> DataFrame:
    """Rows in one cell of floor(score / caliper), and equal in ``exacts``, are matched: treated get a positive index, their
    controls its negative, others 0. ``order`` breaks ties and must tell rows apart for the result to be fixed."""
    if caliper <= 0:
        raise ValueError("the caliper must be positive")
    return _match(df, treatment, [F.floor(expr_of(score) / caliper), *[F.expr(e) for e in exacts]], list(order), k, name)


def exact_matching(df: DataFrame, treatment: str, labels: list[str], *, order: list[str], k: int = 1, name: str = "matching_index") -> DataFrame:
    """The same for rows equal in all labels."""
    return _match(df, treatment, [F.expr(e) for e in labels], list(order), k, name)


def smd(df: DataFrame, treatment: str, cols: list[str]) -> DataFrame:
    """Standardised mean differences: (mean1 - mean0) / sqrt((var0 + var1) / 2), the largest first. One aggregation for all columns."""
    t = expr_of(treatment)
    aggs = []
    for i, c in enumerate(cols):
        for a in (0, 1):
            v = F.when(t == a, expr_of(c))
            aggs += [F.avg(v).alias(f"m{i}_{a}"), F.var_samp(v).alias(f"v{i}_{a}")]
    r = df.agg(*aggs)
    lines = [F.struct(F.lit(c).alias("covariate"), F.col(f"m{i}_0").alias("mean0"), F.col(f"m{i}_1").alias("mean1"), F.try_divide(F.col(f"m{i}_1") - F.col(f"m{i}_0"), F.sqrt((F.col(f"v{i}_0") + F.col(f"v{i}_1")) / 2)).alias("smd")) for i, c in enumerate(cols)]
    return r.select(F.inline(F.array(*lines))).orderBy(F.abs("smd").desc_nulls_last(), "covariate")


class PrognosticScoreMatching:
    """Matching on the outcome that a model of the controls predicts."""

    def __init__(self, treatment: str, outcome: str, covariates: list[str]):
        self.treatment, self.outcome, self.covariates = treatment, outcome, list(covariates)

    def fit(self, df: DataFrame) -> PrognosticScoreMatching:
        self.model: LinearModel = fit_ols(df.where(expr_of(self.treatment) == 0), Formula(self.outcome, self.covariates))
        return self

    def match(self, df: DataFrame, *, caliper: float = 10.0, exacts: list[str] = (), order: list[str]) -> DataFrame:
        scored = df.withColumn("prognostic_score", self.model.predict())
        return caliper_matching(scored, self.treatment, "prognostic_score", caliper, exacts=exacts, order=order)
