"""Job progress, statistics and job listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.schemas import JOB_URL_STATUSES, TERMINAL_STATUSES, URL_STATUSES
from crawlframe.session import small_or_shuffled


def status_counts(job_urls: DataFrame) -> DataFrame:
    """URLs per job and status."""
    return job_urls.groupBy("job_id", "status").agg(F.count("*").alias("urls"))


def _job_totals(job_urls: DataFrame) -> DataFrame:
    """One row per job with a count per status, from one aggregation."""
    return job_urls.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status").isin(*TERMINAL_STATUSES)).alias("terminal"),
        *[F.count_if(F.col("status") == s).alias(s) for s in JOB_URL_STATUSES],
    )


def job_progress(jobs: DataFrame, job_urls: DataFrame) -> DataFrame:
    """Jobs with counts per status and the share of finished URLs."""
    counted = jobs.withColumnRenamed("id", "job_id").join(_job_totals(job_urls), "job_id", "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["total", "terminal", *JOB_URL_STATUSES]}
    filled = counted.withColumns(zeros)
    ratio = F.when(F.col("total") > 0, F.least(F.col("terminal") / F.col("total") * 100, F.lit(100.0))).otherwise(0.0)
    return filled.withColumns({
        "progress_ratio": F.round(ratio, 6),
        "progress_percent": F.bround(ratio, 1),
        "urls_queued": F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("urls_queued")).cast("long"),
    })


def status_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of every job's count per status between two states of its URLs: -1 at the old status, +1 at the new one, summed."""
    moved = before.select("job_id", "status", F.lit(-1).alias("_by")).unionByName(after.select("job_id", "status", F.lit(1).alias("_by")))
    return moved.groupBy("job_id").agg(*[F.sum(F.when(F.col("status") == s, F.col("_by")).otherwise(0)).alias(s) for s in JOB_URL_STATUSES])


def refresh_jobs(jobs: DataFrame, job_urls: DataFrame) -> DataFrame:
    """Running jobs whose URLs are all finished become completed."""
    totals = _job_totals(job_urls).select(F.col("job_id").alias("id"), "total", "terminal")
    done = (F.col("status") == "running") & (F.col("total") > 0) & (F.col("terminal") >= F.col("total"))
    return (
        jobs.join(totals, "id", "left")
        .withColumn("status", F.when(F.coalesce(done, F.lit(False)), "completed").otherwise(F.col("status")))
        .drop("total", "terminal")
    )


def list_jobs(jobs: DataFrame, job_urls: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the newest jobs with their URL counts.

    The page of jobs is picked first; only their URLs are counted.
    """
    page = jobs.orderBy(F.desc("created_at"), "id").offset(offset).limit(max(1, min(limit, 100)))
    ids = F.broadcast(page.select(F.col("id").alias("job_id")))
    counts = job_urls.join(ids, "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("n"))
    return (
        page.join(counts, F.col("id") == F.col("job_id"), "left")
        .withColumns({
            "urls_queued": F.coalesce(F.col("n"), F.col("urls_queued")).cast("long"),
            "url_count": F.coalesce(F.col("n"), F.lit(0)),
        })
        .drop("job_id", "n").orderBy(F.desc("created_at"), "id")
    )


def job_listing_total(jobs: DataFrame) -> DataFrame:
    """Number of all jobs, beside a page of the listing."""
    return jobs.agg(F.count("*").alias("total"))


def urls_per_job(job_urls: DataFrame, jobs: DataFrame) -> DataFrame:
    """URL count of each listed job."""
    ids = small_or_shuffled(jobs.select(F.col("id").alias("job_id")).distinct())
    return job_urls.join(ids, "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("urls"))


def totals(jobs: DataFrame, pages: DataFrame, job_urls: DataFrame) -> DataFrame:
    """(metric, value) rows for the plain counts."""
    def one(df: DataFrame, metric: str, value: Column) -> DataFrame:
        return df.agg(value.alias("value")).select(F.lit(metric).alias("metric"), "value")

    return (
        one(jobs, "jobs_total", F.count("*"))
        .unionByName(one(pages, "pages_indexed", F.count("*")))
        .unionByName(one(job_urls, "failed_urls", F.count_if(F.col("status") == "failed")))
    )


def urls_by_status(urls: DataFrame) -> DataFrame:
    """URLs per status, every status listed; one scan."""
    counts = urls.agg(*[F.count_if(F.col("status") == s).alias(s) for s in URL_STATUSES])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("urls")) for s in URL_STATUSES])).alias("r")
    ).select("r.*")


def top_domains(urls: DataFrame, k: int = 20) -> DataFrame:
    """Domains with the most URLs."""
    return urls.groupBy("domain").agg(F.count("*").alias("urls")).orderBy(F.desc("urls"), "domain").limit(k)


def crawled_since(urls: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Number of URLs crawled in the trailing hours."""
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    return urls.agg(F.count_if(F.col("last_crawled_at") >= cutoff).alias("urls"))


def recent_jobs(jobs: DataFrame, job_urls: DataFrame, k: int = 10) -> DataFrame:
    """The newest jobs with their URL counts."""
    return list_jobs(jobs, job_urls, k).select("id", "status", "urls_queued", "url_count", "created_at")


def stats(jobs: DataFrame, pages: DataFrame, job_urls: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """All statistics as (metric, key, value) rows.

    Status counts and the 24-hour count share one scan of the URL table.
    """
    cutoff = now - F.make_dt_interval(hours=F.lit(24))
    flat = urls.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in URL_STATUSES],
        F.count_if(F.col("last_crawled_at") >= cutoff).alias("_day"),
    )
    entries = [
        F.struct(F.lit("urls_by_status").alias("metric"), F.lit(s).alias("key"), F.col(s).alias("value"))
        for s in URL_STATUSES
    ] + [F.struct(F.lit("crawl_rate_24h").alias("metric"), F.lit("").alias("key"), F.col("_day").alias("value"))]
    by_url = flat.select(F.explode(F.array(*entries)).alias("r")).select("r.*")
    plain = totals(jobs, pages, job_urls).select("metric", F.lit("").alias("key"), "value")
    domains = top_domains(urls).select(F.lit("urls_by_domain").alias("metric"), F.col("domain").alias("key"), F.col("urls").alias("value"))
    recent = recent_jobs(jobs, job_urls).select(
        F.lit("recent_jobs").alias("metric"), F.col("id").cast("string").alias("key"), F.col("url_count").alias("value")
    )
    return plain.unionByName(by_url).unionByName(domains).unionByName(recent)


def schedules(table: DataFrame, enabled_only: bool = False) -> DataFrame:
    """Schedules, newest first."""
    rows = table.filter("enabled") if enabled_only else table
    return rows.orderBy(F.desc("created_at"), "id")
