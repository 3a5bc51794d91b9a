"""Sessions, sources, sinks and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.features import preprocess_na


def build_session(app: str = "effectum", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; other settings as given."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table or view of the catalogue, or Parquet files where the name is a path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are found in a first pass over the file."""
    r = spark.read.option("header", "true")
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", "true").csv(path)


def read_spark(df: DataFrame, str_replace: str = "-1", numeric_replace: float = 0) -> DataFrame:
    """A DataFrame with nulls filled."""
    return preprocess_na(df, str_replace, numeric_replace)


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 16, **options: str) -> DataFrame:
    """A table by JDBC; with a numeric column, in parallel ranges of it."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        r = r.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.option("header", "true").mode(mode).csv(path)


def write_table(df: DataFrame, name: str, *, replace: bool = False, partition_by: list[str] = (), bucket_by: tuple[int, list[str]] | None = None) -> None:
    """Save as a table; buckets by a join key let later joins do without a shuffle."""
    w = df.write.mode("overwrite" if replace else "append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        w = w.bucketBy(bucket_by[0], *bucket_by[1])
    w.saveAsTable(name)


def create_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def _quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def create_table(spark: SparkSession, name: str, schema: str, using: str = "parquet", partition_by: list[str] = ()) -> None:
    spark.sql(f"create table if not exists {_quoted(name)} ({schema}) using {using}" + (f" partitioned by ({', '.join(map(_quoted, partition_by))})" if partition_by else ""))


def insert_table(df: DataFrame, name: str) -> None:
    """Append by column name."""
    df.select(*df.sparkSession.table(name).columns).write.insertInto(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop table if exists {_quoted(name)}")


def drop_partition(spark: SparkSession, name: str, **values: str) -> None:
    spec = ", ".join(f"{_quoted(k)} = '{str(v).replace(chr(39), chr(39) * 2)}'" for k, v in values.items())
    spark.sql(f"alter table {_quoted(name)} drop if exists partition ({spec})")


def show_tables(spark: SparkSession, like: str = "*") -> list[str]:
    return [t.name for t in spark.catalog.listTables(pattern=like)]


def show_create(spark: SparkSession, name: str) -> str:
    return spark.sql(f"show create table {_quoted(name)}").first()[0]


def row_count(spark: SparkSession, name: str) -> int:
    return spark.table(name).count()


def table_meta(spark: SparkSession, name: str) -> DataFrame:
    """Columns with their types and comments."""
    return spark.sql(f"describe table {_quoted(name)}")


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Any SQL, with the statistical pseudo-functions of effectum.plans.sql."""
    from ..plans.sql import sql

    return sql(spark, text)
