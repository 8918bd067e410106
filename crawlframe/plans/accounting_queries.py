"""Job progress, statistics and listing queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.operators import accounting as A
from crawlframe.operators.crawl import stale
from crawlframe.plans import bindings as B
from crawlframe.plans import sql_text as S
from crawlframe.plans.bindings import flat
from crawlframe.schemas import JOB_URL_STATUSES


def status_counts(spark, d):
    return A.status_counts(B.job_urls(spark, d))


def job_progress(spark, d):
    p = A.job_progress(B.jobs(spark, d), B.job_urls(spark, d))
    return flat(p.select("job_id", "total", "terminal", *JOB_URL_STATUSES, "urls_queued", "progress_ratio"))


def job_completion(spark, d):
    return A.refresh_jobs(B.jobs(spark, d), B.job_urls(spark, d)).select("id", "status")


def urls_per_job(spark, d):
    pending = B.jobs(spark, d).filter(F.col("status") == "pending")
    return A.urls_per_job(B.job_urls(spark, d), pending)


def stats_totals(spark, d):
    return A.totals(B.jobs(spark, d), B.pages(spark, d), B.job_urls(spark, d))


def urls_by_status_filled(spark, d):
    return A.urls_by_status(B.urls(spark, d))


def top_domains(spark, d):
    return A.top_domains(B.urls(spark, d))


def crawl_rate_24h(spark, d):
    recrawled = B.job_urls(spark, d).withColumn("last_crawled_at", F.col("updated_at"))
    return A.crawled_since(recrawled, B.now())


def stats_bundle(spark, d):
    return A.stats(B.jobs(spark, d), B.pages(spark, d), B.job_urls(spark, d), B.urls(spark, d), B.now())


def jobs_total(spark, d):
    return A.job_listing_total(B.jobs(spark, d))


def jobs_page(spark, d):
    return flat(A.list_jobs(B.jobs(spark, d), B.job_urls(spark, d), limit=25, offset=50))


def recent_jobs(spark, d):
    return flat(A.recent_jobs(B.jobs(spark, d), B.job_urls(spark, d)))


def schedules_newest(spark, d):
    return flat(A.schedules(B.schedules(spark, d)))


def schedules_enabled(spark, d):
    return flat(A.schedules(B.schedules(spark, d), enabled_only=True))


def stale_urls(spark, d):
    return flat(stale(B.urls(spark, d), B.now(), F.lit(720)).select("id", "normalized_url", "last_crawled_at"))


QUERIES = {f.__name__: f for f in (
    status_counts, job_progress, job_completion, urls_per_job, stats_totals, urls_by_status_filled, top_domains,
    crawl_rate_24h, stats_bundle, jobs_page, jobs_total, recent_jobs, schedules_newest, schedules_enabled, stale_urls,
)}

_JU = S.JOBS + "," + S.JOB_URLS
_TOT = _JU + """,
tot AS (SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('parsed', 'skipped', 'failed')) AS terminal, """ + ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}" for s in JOB_URL_STATUSES) + """ FROM job_urls GROUP BY 1)"""
_PAGE = """jobs_page AS (SELECT * FROM jobs ORDER BY created_at DESC, id LIMIT {n} OFFSET {o}),
cnt AS (SELECT job_id, count(*) AS n FROM job_urls GROUP BY 1)"""
_STATUSES = "(VALUES ('pending'), ('fetched'), ('parsed'), ('failed')) s(status)"

ORACLE = {
    "status_counts": f"WITH {_JU} SELECT job_id, status, count(*) AS urls FROM job_urls GROUP BY 1, 2",
    "job_progress": f"""WITH {_TOT} SELECT id AS job_id, coalesce(total, 0) AS total, coalesce(terminal, 0) AS terminal, """
    + ", ".join(f"coalesce({s}, 0) AS {s}" for s in JOB_URL_STATUSES)
    + """, coalesce(total, urls_queued) AS urls_queued, CASE WHEN total > 0 THEN round(least(terminal / total * 100, 100), 6) ELSE 0.0::DOUBLE END AS progress_ratio
      FROM jobs LEFT JOIN tot ON id = job_id""",
    "job_completion": f"""WITH {_TOT} SELECT id, CASE WHEN status = 'running' AND total > 0 AND terminal >= total THEN 'completed' ELSE status END AS status
      FROM jobs LEFT JOIN tot ON id = job_id""",
    "urls_per_job": f"WITH {_JU} SELECT job_id, count(*) AS urls FROM job_urls WHERE job_id IN (SELECT id FROM jobs WHERE status = 'pending') GROUP BY 1",
    "stats_totals": f"""WITH {_JU} SELECT 'jobs_total' AS metric, count(*) AS value FROM jobs UNION ALL SELECT 'pages_indexed', count(*) FROM pages
      UNION ALL SELECT 'failed_urls', count(*) FROM job_urls WHERE status = 'failed'""",
    "urls_by_status_filled": f"WITH {S.URLS} SELECT s.status, count(urls.id) AS urls FROM {_STATUSES} LEFT JOIN urls ON urls.status = s.status GROUP BY 1",
    "top_domains": f"WITH {S.URLS} SELECT domain, count(*) AS urls FROM urls GROUP BY 1 ORDER BY urls DESC, domain LIMIT 20",
    "crawl_rate_24h": f"WITH {_JU} SELECT count(*) AS urls FROM job_urls WHERE updated_at >= {S.NOW} - INTERVAL 24 HOUR",
    "stats_bundle": f"""WITH {S.URLS}, {_JU}, {_PAGE.format(n=10, o=0)}
      SELECT 'jobs_total' AS metric, '' AS key, count(*) AS value FROM jobs UNION ALL SELECT 'pages_indexed', '', count(*) FROM pages
      UNION ALL SELECT 'failed_urls', '', count(*) FROM job_urls WHERE status = 'failed'
      UNION ALL SELECT 'urls_by_status', s.status, count(urls.id) FROM {_STATUSES} LEFT JOIN urls ON urls.status = s.status GROUP BY s.status
      UNION ALL SELECT 'crawl_rate_24h', '', count(*) FROM urls WHERE last_crawled_at >= {S.NOW} - INTERVAL 24 HOUR
      UNION ALL (SELECT 'urls_by_domain', domain, count(*) FROM urls GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 20)
      UNION ALL SELECT 'recent_jobs', id::VARCHAR, coalesce(n, 0) FROM jobs_page LEFT JOIN cnt ON id = job_id""",
    "jobs_total": f"WITH {S.JOBS} SELECT count(*) AS total FROM jobs",
    "jobs_page": f"""WITH {_JU}, {_PAGE.format(n=25, o=50)} SELECT id, status, coalesce(n, urls_queued) AS urls_queued,
      {S.stamp('created_at')} AS created_at, coalesce(n, 0) AS url_count FROM jobs_page LEFT JOIN cnt ON id = job_id""",
    "recent_jobs": f"""WITH {_JU}, {_PAGE.format(n=10, o=0)} SELECT id, status, coalesce(n, urls_queued) AS urls_queued, coalesce(n, 0) AS url_count,
      {S.stamp('created_at')} AS created_at FROM jobs_page LEFT JOIN cnt ON id = job_id""",
    "schedules_newest": f"WITH {S.SCHEDULES} SELECT * REPLACE ({S.stamp('created_at')} AS created_at) FROM schedules ORDER BY schedules.created_at DESC",
    "schedules_enabled": f"WITH {S.SCHEDULES} SELECT * REPLACE ({S.stamp('created_at')} AS created_at) FROM schedules WHERE enabled",
    "stale_urls": f"""WITH {S.URLS} SELECT id, normalized_url, {S.stamp('last_crawled_at')} AS last_crawled_at FROM urls
      WHERE last_crawled_at IS NULL OR last_crawled_at < {S.NOW} - INTERVAL 720 HOUR""",
}
