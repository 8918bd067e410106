"""Keyed upserts as snapshot merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.urls import domain_of


def squash(delta: DataFrame, key: str, order: list[str], first: list[str], last: list[str]) -> DataFrame:
    """One row per key: ``first`` columns of its earliest row, ``last`` columns of its latest."""
    when = F.struct(*order)
    parts = []
    if first:
        parts.append(F.min_by(F.struct(*first), when).alias("_first"))
    if last:
        parts.append(F.max_by(F.struct(*last), when).alias("_last"))
    out = delta.groupBy(key).agg(*parts)
    return out.select(key, *[f"_first.{c}" for c in first], *[f"_last.{c}" for c in last])


def upsert(base: DataFrame, delta: DataFrame, key: str, order: list[str],
           keep: list[str], overwrite: list[str]) -> DataFrame:
    """Merge a delta into a snapshot.

    An existing row keeps its ``keep`` columns and takes the ``overwrite`` columns; a new key takes
    all of them. Merging the same delta again changes nothing.
    """
    new = squash(delta, key, order, keep, overwrite).withColumn("_new", F.lit(True))
    old = base.withColumn("_old", F.lit(True)).alias("o")
    joined = old.join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def column(name: str) -> Column:
        if name == key:
            return F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)
        if name in keep:
            return F.when(F.col("o._old"), F.col(f"o.{name}")).otherwise(F.col(f"n.{name}")).alias(name)
        if name in overwrite:
            return F.when(F.col("n._new"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)
        return F.col(f"o.{name}").alias(name)

    return joined.select(*[column(c) for c in base.columns])


def url_id(normalized_url: Column) -> Column:
    """Deterministic row id of a canonical URL."""
    return F.substring(F.sha2(F.concat(F.lit("url:"), normalized_url), 256), 1, 32)


def upsert_urls(urls: DataFrame, parsed: DataFrame, order: list[str], crawled_at: str = "timestamp") -> DataFrame:
    """Parsed pages into the URL table; identity columns stay with the first writer."""
    delta = parsed.select(
        "normalized_url",
        url_id(F.col("normalized_url")).alias("id"),
        F.col("job_id").cast("string").alias("job_id"),
        F.col("url").alias("canonical_url"),
        domain_of(F.col("normalized_url")).alias("domain"),
        F.lit("parsed").alias("status"),
        F.col("checksum").alias("content_hash"),
        "depth",
        F.col(crawled_at).alias("last_crawled_at"),
        F.col(crawled_at).alias("created_at"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )
    return upsert(
        urls, delta, "normalized_url", [f"_o{i}" for i in range(len(order))],
        keep=["id", "job_id", "canonical_url", "domain", "depth", "created_at"],
        overwrite=["status", "content_hash", "last_crawled_at"],
    )


def upsert_artifacts(artifacts: DataFrame, parsed: DataFrame, order: list[str]) -> DataFrame:
    """Storage key, checksum and size by url_id."""
    return upsert(
        artifacts, parsed, "url_id", order,
        keep=[c for c in ("id", "http_status", "fetched_at") if c in artifacts.columns],
        overwrite=["storage_key", "checksum", "size_bytes"],
    )


def upsert_pages(pages: DataFrame, cleaned: DataFrame, order: list[str]) -> DataFrame:
    """Content columns by url_id; id and created_at stay with the first writer."""
    content = ["title", "description", "language", "text_snippet", "extracted_links", "metadata", "schema_types"]
    return upsert(
        pages, cleaned, "url_id", order,
        keep=[c for c in ("id", "created_at") if c in pages.columns],
        overwrite=[c for c in content if c in pages.columns],
    )


def hash_snapshot(urls: DataFrame) -> DataFrame:
    """Stored hashes for the next run's change detection."""
    return urls.filter(F.col("content_hash").isNotNull()).select("normalized_url", "content_hash")
