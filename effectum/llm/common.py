"""What the corpus operators share: input columns, tables in the shared folder, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that Python code works on at once; longer single texts are a piece of their own.
PIECE_BYTES = 2 << 20
#: Rows, and bytes, that Spark hands to Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: How tables are written: small row groups, so that a task that writes long values holds little.
TABLE = {"parquet.block.size": 16 << 20}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves, but only in local mode; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="effectum-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/effectum/{name}-{uuid.uuid4().hex}"


#: Rows of documents for each task that writes a table made of them, and tasks at least: few rows don't need hundreds of files.
ROWS_A_TASK, TASKS = 20_000, 8


def materialise(df: DataFrame, name: str, of: int | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks that ran on it, and a table
    that several later stages read is computed once. ``of`` is the number of documents that the table is about; shuffled partitions
    are written by tasks in proportion to it at most.
    """
    path = new_path(df.sparkSession, name)
    if of is not None:
        df = df.coalesce(max(TASKS, -(-of // ROWS_A_TASK)))
    df.write.options(**TABLE | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again; a table that is already gone is no error."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of one key from which ``spread_join`` takes them out of the shuffle, and how many such keys there can be at most.
HEAVY, HEAVY_KEYS = 500, 100_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join with a table that has one row for each key, with the number ``rows`` of rows that have it; ``rows`` is dropped.

    Keys with at least ``HEAVY`` rows, and a ``HEAVY_KEYS``-th of the total, are broadcast: there can't be more than ``HEAVY_KEYS`` of them,
    whatever the input. So their rows stay where they are, and only rows of lighter keys are shuffled.
    """
    least = max(HEAVY, -(-total // HEAVY_KEYS))
    heavy = F.broadcast(table.where(F.col("rows") >= least).drop("rows"))
    light = table.where(F.col("rows") < least).drop("rows")
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text of each row, under the names doc_id and text; a null text is empty.

    Further columns of the input, whatever their names, have no influence.
    """
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bounded(df: DataFrame) -> DataFrame:
    """The same DataFrame; its session hands rows to Python in batches of at most ``BATCH_ROWS`` and about ``BATCH_BYTES`` from now on.

    Whole texts are long, so the default of 10,000 rows would hold tens of MB for each task on either side. Code that works better on more
    at once gathers batches itself (``pieces``).
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes: small batches are joined, large ones cut, single long texts left alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from _cut(_join(held), size)
            held = []
    if held:
        yield from _cut(_join(held), size)


def _join(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def _cut(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if n < 2 or batch.nbytes <= 2 * size:
        if n:
            yield batch
        return
    yield from _cut(batch.slice(0, n // 2), size)
    yield from _cut(batch.slice(n // 2), size)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that isn't taken."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of the few types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    out = []
    for field in ddl.split(","):
        name, kind = field.split()
        out.append((name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(out)


class Memo(dict):
    """What ``make`` gives for a key, made once and remembered; begun anew when it holds ``size`` keys."""

    def __init__(self, make, size: int):
        self.make, self.size = make, size

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.size:
            self.clear()
        self[key] = value
        return value
