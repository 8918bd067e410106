"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.session import run_folder
from crawlframe.sources.snapshots import remove


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a batch that goes to or comes from a Python worker: with 10,000, Spark's default, the texts of a batch take 64 MB in
#: the JVM and again in the worker, for each task and both ways.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
#: Whether a statement's shuffle files go with it, not with Java's next collection of its frame.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most BATCH_ROWS rows at once; a smaller number set by the user stays."""
    if not 0 < int(spark.conf.get(BATCH_CONF, "10000")) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the frame below the shared folder and read it back: later steps survive lost executors, and need none of the shuffles
    before, which are removed."""
    spark = df.sparkSession
    path = run_folder(spark, label)
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(*frames: DataFrame) -> None:
    """Remove the tables of stored frames: whatever was made from them is stored itself, and no later step reads them."""
    for df in frames:
        remove(df.sparkSession, df.stored_at)


def arrow_schema(ddl: str) -> pa.Schema:
    """On the driver only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, work: Callable[[dict], Iterator[dict] | dict], schema: str, rows_at_once: int = 2_000) -> DataFrame:
    """Run ``work`` on pieces of Arrow batches given as {column: list}; it returns the same for the result, or an iterator of them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def batches(rows):
        for batch in rows:
            for at in range(0, batch.num_rows, rows_at_once):
                out = work(batch.slice(at, rows_at_once).to_pydict())
                for part in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_pydict({f.name: pa.array(part[f.name], f.type) for f in target}, schema=target)

    return df.mapInArrow(batches, schema)


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor
