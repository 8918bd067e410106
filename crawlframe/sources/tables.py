"""Relational scans and keyed page storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.functions.urls import url_key
from crawlframe.session import small_or_shuffled


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet scan; zone-less timestamps become timestamps of the session time zone."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """Relational scan over JDBC, split by a numeric key; filters and columns are pushed down."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", table)
        .option("partitionColumn", key).option("lowerBound", low).option("upperBound", high)
        .option("numPartitions", parts).load()
    )


def storage_key(job_id: Column, normalized_url: Column) -> Column:
    return F.concat(job_id.cast("string"), F.lit("/"), url_key(normalized_url), F.lit(".html"))


def artifacts(pages: DataFrame, job_id: Column, normalized_url: str = "normalized_url", html: str = "html") -> DataFrame:
    """Key, checksum and byte size of every raw page."""
    return pages.withColumns(
        {
            "storage_key": storage_key(job_id, F.col(normalized_url)),
            "checksum": F.sha2(F.col(html), 256),
            "size_bytes": F.octet_length(F.col(html)),
        }
    )


def write_artifacts(pages: DataFrame, folder: str, buckets: int = 64, mode: str = "append") -> None:
    """Store raw pages below a bucket of the key, so one large job spreads over many files."""
    (
        pages.withColumn("bucket", F.pmod(F.xxhash64("storage_key"), F.lit(buckets)).cast("int"))
        .write.mode(mode).partitionBy("bucket").parquet(folder)
    )


def read_artifacts(spark: SparkSession, folder: str, wanted: DataFrame, keys: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Raw pages of the wanted keys; the bucket in the join condition prunes folders."""
    keyed = wanted.withColumn(
        "bucket", F.pmod(F.xxhash64("storage_key"), F.lit(buckets)).cast("int")
    )
    return spark.read.parquet(folder).join(small_or_shuffled(keyed), ["bucket", *(keys or ["storage_key"])]).drop("bucket")


def read_html_files(spark: SparkSession, folder: str) -> DataFrame:
    """Raw page files `<job>/<key>.html` as (storage_key, html)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option(
        "recursiveFileLookup", "true"
    ).load(folder)
    return files.select(
        F.regexp_extract("path", r"([^/]+/[^/]+\.html)$", 1).alias("storage_key"),
        F.col("content").cast("string").alias("html"),
    )
