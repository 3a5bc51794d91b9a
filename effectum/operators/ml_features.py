"""Feature pipelines and the propensity model of MLlib, and what remains of resampling and sources."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, QuantileDiscretizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .matching import smd


def get_num_cat_feat(df: DataFrame, exclude: list[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric columns, and those of text."""
    own = [f for f in df.schema.fields if f.name not in exclude]
    return [f.name for f in own if isinstance(f.dataType, NumericType)], [f.name for f in own if f.dataType.typeName() == "string"]


def str_index_cat_cols(cols: list[str]) -> list[StringIndexer]:
    return [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in cols]


def one_hot_encode_cat_cols(cols: list[str]) -> list:
    """Stages that index the levels of text and make indicator vectors of them."""
    return [*str_index_cat_cols(cols), OneHotEncoder(inputCols=[f"{c}_index" for c in cols], outputCols=[f"{c}_onehot" for c in cols], handleInvalid="keep")] if cols else []


def quantile_num_cols(cols: list[str], bins: int = 2, relative_error: float = 0.001) -> list[QuantileDiscretizer]:
    return [QuantileDiscretizer(inputCol=c, outputCol=f"{c}_bin", numBuckets=bins, relativeError=relative_error, handleInvalid="keep") for c in cols]


def assemble_into_features(num_cols: list[str], cat_cols: list[str], scale_method: str | None = None, one_hot_cols: list[str] = ()) -> list:
    """Stages that put all columns in one vector, scaled by range ('minmax') or deviation ('standard') on demand."""
    inputs = [*num_cols, *[f"{c}_onehot" if c in one_hot_cols else f"{c}_index" for c in cat_cols]]
    if scale_method is None:
        return [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]
    scalers = {"minmax": MinMaxScaler, "standard": StandardScaler}
    if scale_method not in scalers:
        raise ValueError("scale_method must be minmax, standard or None")
    return [VectorAssembler(inputCols=inputs, outputCol="raw_features", handleInvalid="keep"), scalers[scale_method](inputCol="raw_features", outputCol="features")]


def feature_process(df: DataFrame, label: str, exclude: list[str] = (), scale_method: str | None = "minmax", one_hot: bool = False, one_hot_threshold: int = 30) -> DataFrame:
    """The rows with a features vector; text with few levels becomes indicators, other text an index."""
    num, cat = get_num_cat_feat(df, [label, *exclude])
    few: list[str] = []
    if one_hot and cat:
        levels = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cat]).first()
        few = [c for c in cat if levels[c] <= one_hot_threshold]
    stages = [*str_index_cat_cols([c for c in cat if c not in few]), *one_hot_encode_cat_cols(few), *assemble_into_features(num, cat, scale_method, few)]
    filled = df.fillna(0, num).fillna("-1", cat)
    return Pipeline(stages=stages).fit(filled).transform(filled)


def logistic_regression(df: DataFrame, label: str, x: list[str], categorical: list[str] = (), max_iter: int = 40, reg: float = 0.0, elastic: float = 0.8) -> DataFrame:
    """Rows with prob from MLlib's logistic regression; text columns become indicators."""
    num = [c for c in x if c not in categorical]
    data = feature_process(df.select(label, *num, *categorical), label, one_hot=True, one_hot_threshold=10**9)
    model = LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter, regParam=reg, elasticNetParam=elastic).fit(data)
    return model.transform(data).select(label, *num, *categorical, F.get(vector_to_array("probability"), F.lit(1)).alias("prob"))


def get_num_smd(df: DataFrame, treatment: str, features: list[str]) -> DataFrame:
    return smd(df, treatment, features)


def regression_string(y: str, x: list[str]) -> str:
    return f"{y} ~ {' + '.join(x)}"


def partition_row_counts(df: DataFrame) -> DataFrame:
    """How many rows each partition has."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
