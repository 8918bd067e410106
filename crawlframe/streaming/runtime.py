"""Running streams to completion and keeping their results as replayable batch folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ADAPTIVE = "spark.sql.adaptive.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with expiry and timers needs the RocksDB store."""
    spark.conf.set(STATE_STORE, ROCKSDB)


class BatchLog:
    """Append-only table with one folder per micro-batch.

    A repeated batch overwrites its own folder, so a restart adds nothing twice. Readers see the
    batch number and can keep the latest row of a key.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.folder)

    def latest(self, spark: SparkSession, keys: list[str]) -> DataFrame:
        """Last written row of every key."""
        rows = self.read(spark)
        values = [c for c in rows.columns if c not in (*keys, "batch")]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("_r"))
        return newest.select(*keys, "_r.*")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None],
                  mode: str = "append") -> None:
    """Process everything the source holds now, batch by batch, then stop.

    Batches without data are off: state on processing time would ask for one after another. A stream plans without adaptive
    execution; what ``each`` does to a batch is batch work and has it as the session does, so that few rows take few tasks.
    """
    spark = stream.sparkSession
    before = spark.conf.get(NO_DATA, "true")
    adaptive = spark.conf.get(ADAPTIVE, "true")

    def treat(batch: DataFrame, batch_id: int) -> None:
        conf = batch.sparkSession.conf
        planned = conf.get(ADAPTIVE, "true")
        conf.set(ADAPTIVE, adaptive)
        try:
            each(batch, batch_id)
        finally:
            conf.set(ADAPTIVE, planned)

    spark.conf.set(NO_DATA, "false")
    try:
        query = (
            stream.writeStream.foreachBatch(treat).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(NO_DATA, before)


def collect_stream(stream: DataFrame, folder: str, mode: str = "append") -> BatchLog:
    """Run a stream over what its source holds and keep the result below ``folder``."""
    log = BatchLog(f"{folder}/rows")
    run_available(stream, f"{folder}/checkpoint", log.write, mode)
    return log


def table_stream(spark: SparkSession, folder: str, name: str, max_files: int = 16) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream, with the schema of the table."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, because the source takes a plain path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path[:-1]}[{path[-1]}]")
