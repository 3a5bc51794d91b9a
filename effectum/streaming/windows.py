"""Event-time windows over streams (or tables: the same code serves both)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def windowed(events: DataFrame, time: str, keys: list[str], aggs: list[Column], size: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones with a ``slide``; rows later than ``delay`` behind the newest are left out of a stream."""
    rows = events.withWatermark(time, delay) if delay else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[c for c in _names(aggs)])


def sessions(events: DataFrame, time: str, keys: list[str], aggs: list[Column], gap: str, delay: str | None = None) -> DataFrame:
    """Sessions that end after a gap."""
    rows = events.withWatermark(time, delay) if delay else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *_names(aggs))


def _names(aggs: list[Column]) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2].strip("`") for a in aggs]


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and return its result from memory (for tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def running_ttest(events: DataFrame, time: str, y: str, index: str, size: str, delay: str) -> DataFrame:
    """The moments of each arm by window, from which a t-test of each window follows."""
    arm = F.expr(index).cast("int").alias("arm")
    rows = events.withColumn("arm", arm)
    v = F.expr(y).cast("double")
    return windowed(rows, time, ["arm"], [F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance")], size, delay=delay)
