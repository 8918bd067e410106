"""Keyed tables in hash buckets, changed by micro-batches.

A merge reads and rewrites only the buckets that its delta touches; the other buckets keep their files. Which files are the
table is told by a manifest, one small Parquet file per version, which appears whole or not at all. It also
names the last batch of every writer, so that a repeated batch changes nothing. One writer at a time may merge into a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "bucket int, path string, writer string, batch long"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, for listing and deleting folders."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it does not exist."""
    fs, p = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


class Snapshot:
    """A table with unique ``keys`` below ``folder``."""

    def __init__(self, folder: str, keys: list[str], schema: T.StructType, buckets: int = 64):
        self.folder, self.keys, self.schema, self.buckets = folder.rstrip("/"), keys, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def state(self, spark: SparkSession) -> tuple[int, dict[int, str], dict[str, int]]:
        """(version, folder of each filled bucket, last batch of each writer)."""
        versions = [int(n.split("=")[1]) for n in folders(spark, f"{self.folder}/manifests") if "_SUCCESS" in folders(spark, f"{self.folder}/manifests/{n}")]
        if not versions:
            return 0, {}, {}
        rows = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/version={max(versions)}").collect()
        return max(versions), {r["bucket"]: r["path"] for r in rows if r["path"]}, {r["writer"]: r["batch"] for r in rows if r["writer"]}

    def _rows(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession, touched: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        _, paths, _ = self.state(spark)
        return self._rows(spark, [p for b, p in sorted(paths.items()) if touched is None or b in touched])

    def touched(self, delta: DataFrame) -> list[int]:
        """Buckets of the delta's keys; at most ``buckets`` numbers."""
        return sorted(r[0] for r in delta.select(self.bucket()).distinct().collect())

    def known(self, delta: DataFrame) -> DataFrame:
        """Rows of the buckets that the delta touches."""
        return self.read(delta.sparkSession, self.touched(delta))

    def done(self, spark: SparkSession, writer: str, batch: int) -> bool:
        """Whether this batch of the writer is in the table already."""
        return self.state(spark)[2].get(writer, -1) >= batch

    def merge(self, delta: DataFrame, how: Merge, writer: str, batch: int) -> bool:
        """Replace the touched buckets by ``how(their rows, delta)``; false if the batch was merged before. Removes what the
        manifest before the last one alone named."""
        spark = delta.sparkSession
        version, paths, marks = self.state(spark)
        if marks.get(writer, -1) >= batch:
            return False
        touched = self.touched(delta)
        new = dict(paths)
        if touched:
            target = f"{self.folder}/data/{writer}-{batch}"
            rows = how(self._rows(spark, [paths[b] for b in touched if b in paths]), delta)
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
            (rows.withColumn("_bucket", self.bucket()).repartition(len(touched), "_bucket")
             .write.mode("overwrite").partitionBy("_bucket").parquet(target))
            new |= {b: f"{target}/_bucket={b}" for b in touched}
        marks = marks | {writer: batch}
        rows = [(b, p, None, None) for b, p in new.items()] + [(None, None, w, n) for w, n in marks.items()]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/version={version + 1}")
        self._clean(spark, version, set(paths.values()) | set(new.values()))
        return True

    def _clean(self, spark: SparkSession, before: int, named: set[str]) -> None:
        """Readers of the version before may still be at work, so that one stays."""
        for n in folders(spark, f"{self.folder}/manifests"):
            if int(n.split("=")[1]) < before:
                remove(spark, f"{self.folder}/manifests/{n}")
        for run in folders(spark, f"{self.folder}/data"):
            for b in folders(spark, f"{self.folder}/data/{run}"):
                if b.startswith("_bucket=") and f"{self.folder}/data/{run}/{b}" not in named:
                    remove(spark, f"{self.folder}/data/{run}/{b}")
