"""Session-level helpers: checkpoint folder, durable frames, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating one only for a local session that names none."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    active = sc.getCheckpointDir()
    if active:
        return active
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="crawlframe-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder for one run's tables and stream state."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs one re-read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """True if the frame holds at most ``max_rows`` rows and about ``max_bytes`` bytes.

    The check reads no more than ``max_rows + 1`` rows.
    """
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(field.name)))), F.lit(0))
        else:
            width = width + F.lit(16)
    row = (
        df.select(width.alias("w"))
        .limit(max_rows + 1)
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("b"))
        .first()
    )
    return row["n"] <= max_rows and row["b"] <= max_bytes


def small_or_shuffled(df: DataFrame, max_rows: int = 500_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Mark a join side for broadcast if its measured size is within the bound.

    A larger side gets the sort-merge hint, which leaves skewed keys to the adaptive skew join.
    """
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly row work on a scan of few partitions; a larger scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
