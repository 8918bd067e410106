"""Ledger of a stage as a table: which keys have passed, in buckets, one folder a micro-batch.

It takes the place of a deduplication state that would grow for ever in the state store: a batch reads the keys of the buckets it
touches, and only those of earlier batches, so a repeated batch decides as it did the first time and writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.operators.dedup import earliest
from crawlframe.session import small_or_shuffled
from crawlframe.sources.snapshots import folders

KEYS = "key string, bucket int, batch long"


class Ledger:
    def __init__(self, folder: str, buckets: int = 64):
        self.folder, self.buckets = folder.rstrip("/"), buckets

    def _batches(self, spark) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in folders(spark, self.folder) if n.startswith("batch="))

    def first_time(self, events: DataFrame, key: Column, order: list[str], batch: int) -> DataFrame:
        """The first event (by ``order``) of every key that no earlier batch has passed; they are written down as passed.

        The result is persisted, with the columns _key and _bucket; who uses it unpersists it.
        """
        spark = events.sparkSession
        keyed = events.withColumn("_key", key)
        fresh = earliest(keyed, ["_key"], order).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int"))
        if any(b < batch for b in self._batches(spark)):
            asked = small_or_shuffled(fresh.select(F.col("_key").alias("key"), F.col("_bucket").alias("bucket")))
            # the bucket is in the join, so its folders are pruned once the asked ones are known
            known = spark.read.schema(KEYS).parquet(self.folder).where(F.col("batch") < batch).join(asked, ["bucket", "key"], "left_semi")
            fresh = fresh.join(known.select(F.col("key").alias("_key")), "_key", "left_anti")
        fresh = fresh.persist()
        (fresh.select(F.col("_key").alias("key"), F.col("_bucket").alias("bucket")).repartition("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={batch}"))
        return fresh
