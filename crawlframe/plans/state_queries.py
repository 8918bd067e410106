"""Ledger, claim, change-detection, merge and status queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.operators import crawl, dedup, merge
from crawlframe.operators.corpus import clean_pages, extract_pages
from crawlframe.plans import bindings as B
from crawlframe.plans import sql_text as S
from crawlframe.plans.bindings import flat


def _keyed_events(spark, d):
    e = B.events(spark, d)
    return e.withColumn("ref", F.concat_ws(":", F.col("user_id").cast("string"), F.col("k").cast("string")))


def idempotency_ledger(spark, d):
    """Signups are the ledger of an earlier run; all other events arrive now."""
    e = _keyed_events(spark, d).withColumn("stage", F.when(F.col("event_type") == "error", "parser").otherwise("crawler"))
    old = e.filter(F.col("event_type") == "signup").select("ref", "stage")
    new = e.filter(F.col("event_type") != "signup")
    return flat(dedup.ledger(new, ["ts", "event_id"], old, keys=("ref", "stage")).select("ref", "stage", "event_id"))


def ledger_duplicates(spark, d):
    e = _keyed_events(spark, d).withColumn("stage", F.lit("crawler"))
    seen = e.groupBy("ref", "stage").agg(F.count("*").alias("n"))
    return seen.groupBy("stage").agg(F.count("*").alias("accepted"), F.sum(F.col("n") - 1).alias("duplicates"))


def ttl_claims(spark, d):
    return flat(dedup.ttl_claims(B.events(spark, d), "user_id", "ts", dedup.HOUR).select("user_id", "ts"))


def ttl_claims_forced(spark, d):
    e = B.events(spark, d).withColumn("force", F.col("event_type") == "purchase")
    return flat(dedup.ttl_claims(e, "user_id", "ts", dedup.DAY, force="force"))


def queue_if_absent(spark, d):
    """Queue one row per (user, k) that has no row yet; clicks are queued already."""
    e = _keyed_events(spark, d).select(F.col("user_id").alias("job_id"), "ref", "event_id", "event_type")
    queued = dedup.earliest(e.filter(F.col("event_type") == "click"), ["job_id", "ref"], ["event_id"]).select("job_id", "ref", F.lit("old").alias("origin"))
    incoming = e.filter(F.col("event_type") != "click").select("job_id", "ref", F.lit("new").alias("origin"), "event_id")
    return dedup.insert_if_absent(queued, incoming, ["job_id", "ref"], ["event_id"]).select("job_id", "ref", "origin")


def _snapshot(spark, d):
    """Stored hashes: exact for the first third of the ids by remainder, altered for the next, none for the rest."""
    stored = F.when(F.col("page_id") % 3 == 0, F.sha2("html", 256)).when(
        F.col("page_id") % 3 == 1, F.sha2(F.concat(F.col("html"), F.lit("!")), 256))
    return B.canonical_pages(spark, d, stored.alias("content_hash")).select("normalized_url", "content_hash")


def content_change(spark, d):
    fetched = B.hashed_pages(spark, d, "job").select("page_id", "normalized_url", "checksum")
    changes = dedup.content_changes(fetched, _snapshot(spark, d))
    return flat(changes.select("page_id", "normalized_url", "checksum", "change"))


def touch_unchanged(spark, d):
    fetched = B.hashed_pages(spark, d, "job").select("normalized_url", "checksum")
    changes = dedup.content_changes(fetched, _snapshot(spark, d))
    urls = B.urls(spark, d).select("normalized_url", "last_crawled_at")
    return flat(dedup.touch_unchanged(urls, changes, B.now()))


def _parsed(spark, d):
    """Parsed events of every page: one per event of the user of that number, so keys repeat."""
    p = B.canonical_pages(spark, d)
    e = B.events(spark, d)
    return p.join(e, p.page_id == e.user_id).select(
        "normalized_url", F.col("event_id").alias("job_id"), F.concat(F.col("url"), F.lit("#"), F.col("k")).alias("url"),
        F.sha2(F.concat(F.col("normalized_url"), F.col("event_id").cast("string")), 256).alias("checksum"),
        F.col("k").alias("depth"), F.col("ts").alias("timestamp"), "event_id",
    )


def upsert_urls(spark, d):
    """The URL table keeps its odd rows only where the job number is even or missing; the rest is new."""
    base = B.urls(spark, d).filter(F.coalesce(F.col("job_id"), F.lit(0)) % 2 == 0).withColumn("id", F.col("id").cast("string"))
    out = merge.upsert_urls(base, _parsed(spark, d), ["timestamp", "event_id"])
    return flat(out.select("normalized_url", F.col("job_id").cast("string").alias("job_id"), "canonical_url", "domain", "status", "content_hash", "depth", "last_crawled_at", "created_at"))


def upsert_pages(spark, d):
    """Cleaned page records into an older page table that holds the pages of three languages."""
    cleaned = clean_pages(extract_pages(B.pages(spark, d)))
    delta = cleaned.select(
        F.sha2("url", 256).alias("url_id"), "title", "description", "language", "text_snippet", "page_id",
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("created_at"),
    )
    # the older table has one row a URL, as the merge leaves it
    old = dedup.earliest(delta.filter(F.col("language").isin("en", "fr", "de")).select("url_id", "language", "page_id"), ["url_id"], ["page_id"]).select(
        "url_id", F.lit("old").alias("title"), F.lit("old").alias("description"), "language",
        F.lit(None).cast("string").alias("text_snippet"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )
    return flat(merge.upsert_pages(old, delta, ["page_id"]))


def upsert_artifacts(spark, d):
    raw = B.hashed_pages(spark, d, "job-2").select(F.sha2("normalized_url", 256).alias("url_id"), "storage_key", "checksum", "size_bytes", "page_id", F.lit(200).alias("http_status"))
    old = raw.filter(F.col("size_bytes") > 10000).select("url_id", F.lit("old").alias("storage_key"), F.lit("old").alias("checksum"), F.lit(0).alias("size_bytes"), F.lit(201).alias("http_status"))
    return flat(merge.upsert_artifacts(old, raw, ["page_id"]))


def _transitions(spark, d):
    """Every event as a status change of (user, k); high values carry an error, even k a checkpoint."""
    status = F.element_at(F.create_map(
        F.lit("click"), F.lit("queued"), F.lit("view"), F.lit("fetched"), F.lit("purchase"), F.lit("parsed"),
        F.lit("signup"), F.lit("skipped"), F.lit("error"), F.lit("failed")), F.col("event_type"))
    return B.events(spark, d).select(
        (F.col("user_id") % 10).alias("job_id"),
        F.concat(F.lit("http://h/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("k") % 5).cast("string")).alias("normalized_url"),
        status.alias("status"), F.when(F.col("value") > 60, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"),
        F.when(F.col("k") % 2 == 0, F.col("props")).alias("checkpoint"), "ts", "event_id",
    )


def status_current(spark, d):
    return flat(crawl.current_status(_transitions(spark, d), ["ts", "event_id"]))


def status_merge(spark, d):
    """Transitions merged into a table that already holds the rows of even jobs as claimed."""
    t = _transitions(spark, d)
    base = t.filter(F.col("job_id") % 2 == 0).select("job_id", "normalized_url").distinct().select(
        "job_id", "normalized_url", F.lit(2).alias("depth"), F.lit("claimed").alias("status"), F.lit("base").alias("error"),
        F.lit(None).cast("string").alias("checkpoint"), F.lit("2023-01-01").cast("timestamp").alias("updated_at"),
    )
    return flat(crawl.apply_transitions(base, t, ["ts", "event_id"], "ts"))


QUERIES = {f.__name__: f for f in (
    idempotency_ledger, ledger_duplicates, ttl_claims, ttl_claims_forced, queue_if_absent, content_change,
    touch_unchanged, upsert_urls, upsert_pages, upsert_artifacts, status_current, status_merge,
)}

_KEYED = S.EVENTS + """,
ke AS (SELECT *, user_id || ':' || k AS ref FROM ev)"""
_SNAP = S.CANONICAL_PAGES + """,
snap AS (SELECT nu, CASE WHEN page_id % 3 = 0 THEN sha256(html) WHEN page_id % 3 = 1 THEN sha256(html || '!') END AS h FROM cpages)"""
_PARSED = S.URLS + "," + S.EVENTS + """,
parsed AS (SELECT nu AS normalized_url, event_id AS job_id, url || '#' || k AS url, sha256(nu || event_id) AS checksum, k AS depth, ts, event_id
  FROM cpages JOIN ev ON page_id = user_id),
base AS (SELECT * FROM urls WHERE coalesce(job_id, 0) % 2 = 0)"""
_TRANS = S.EVENTS + """,
tr AS (SELECT user_id % 10 AS job_id, 'http://h/' || user_id || '/' || (k % 5) AS normalized_url,
  CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'fetched' WHEN 'purchase' THEN 'parsed' WHEN 'signup' THEN 'skipped' ELSE 'failed' END AS status,
  CASE WHEN value > 60 THEN 'e' || event_id END AS error, CASE WHEN k % 2 = 0 THEN props END AS checkpoint, ts, event_id FROM ev),
cur AS (SELECT job_id, normalized_url, arg_max(status, (ts, event_id)) AS status,
  arg_max(error, (ts, event_id)) FILTER (error IS NOT NULL) AS error, arg_max(checkpoint, (ts, event_id)) FILTER (checkpoint IS NOT NULL) AS checkpoint,
  max(ts) AS updated_at FROM tr GROUP BY 1, 2)"""

ORACLE = {
    "idempotency_ledger": f"""WITH {_KEYED}, st AS (SELECT *, CASE WHEN event_type = 'error' THEN 'parser' ELSE 'crawler' END AS stage FROM ke)
      SELECT ref, stage, arg_min(event_id, (ts, event_id)) AS event_id FROM st WHERE event_type <> 'signup'
      AND (ref, stage) NOT IN (SELECT (ref, stage) FROM st WHERE event_type = 'signup') GROUP BY ref, stage""",
    "ledger_duplicates": f"""WITH {_KEYED} SELECT 'crawler' AS stage, count(DISTINCT ref) AS accepted, count(*) - count(DISTINCT ref) AS duplicates FROM ke""",
    "ttl_claims": f"""WITH RECURSIVE c AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL
      SELECT e.user_id, min(e.ts) FROM c JOIN events e ON e.user_id = c.user_id AND e.ts >= c.ts + INTERVAL 1 HOUR GROUP BY e.user_id, c.ts)
      SELECT user_id, {S.stamp('ts')} AS ts FROM c""",
    "ttl_claims_forced": f"""WITH RECURSIVE seg AS (SELECT user_id, ts, event_type, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts) AS s FROM events),
      pl AS (SELECT user_id, s, ts FROM seg WHERE event_type <> 'purchase'),
      c AS (SELECT user_id, s, min(ts) AS ts FROM pl GROUP BY 1, 2 UNION ALL
        SELECT e.user_id, e.s, min(e.ts) FROM c JOIN pl e ON e.user_id = c.user_id AND e.s = c.s AND e.ts >= c.ts + INTERVAL 24 HOUR GROUP BY e.user_id, e.s, c.ts)
      SELECT user_id, {S.stamp('ts')} AS ts, false AS forced FROM c UNION ALL
      SELECT user_id, {S.stamp('ts')}, true FROM events WHERE event_type = 'purchase'""",
    "queue_if_absent": f"""WITH {_KEYED} SELECT user_id AS job_id, ref, CASE WHEN bool_or(event_type = 'click') THEN 'old' ELSE 'new' END AS origin FROM ke GROUP BY 1, 2""",
    "content_change": f"""WITH {_SNAP} SELECT page_id, nu AS normalized_url, sha256(html) AS checksum,
      CASE WHEN h IS NULL THEN 'new' WHEN h = sha256(html) THEN 'unchanged' ELSE 'changed' END AS change FROM cpages LEFT JOIN snap USING (nu)""",
    "touch_unchanged": f"""WITH {S.URLS} SELECT normalized_url, CASE WHEN id % 3 = 0 THEN {S.stamp(S.NOW)} ELSE {S.stamp('last_crawled_at')} END AS last_crawled_at FROM urls""",
    "upsert_urls": f"""WITH {_PARSED}, n AS (SELECT normalized_url, arg_min(job_id, (ts, event_id)) AS job_id, arg_min(url, (ts, event_id)) AS url,
        arg_min(depth, (ts, event_id)) AS depth, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(checksum, (ts, event_id)) AS checksum FROM parsed GROUP BY 1)
      SELECT coalesce(b.normalized_url, n.normalized_url) AS normalized_url,
        (CASE WHEN b.normalized_url IS NULL THEN n.job_id ELSE b.job_id END)::VARCHAR AS job_id,
        coalesce(b.canonical_url, n.url) AS canonical_url, coalesce(b.domain, {S.host('n.normalized_url')}) AS domain,
        CASE WHEN n.normalized_url IS NOT NULL THEN 'parsed' ELSE b.status END AS status,
        coalesce(n.checksum, b.content_hash) AS content_hash, coalesce(b.depth, n.depth)::BIGINT AS depth,
        {S.stamp('CASE WHEN n.normalized_url IS NOT NULL THEN n.last_ts ELSE b.last_crawled_at END')} AS last_crawled_at,
        {S.stamp('CASE WHEN b.normalized_url IS NULL THEN n.first_ts ELSE b.created_at END')} AS created_at
      FROM base b FULL OUTER JOIN n ON b.normalized_url = n.normalized_url""",
    "upsert_pages": f"""WITH {S.markup()} SELECT sha256(url) AS url_id, {S.collapse(S.TITLE, 1024)} AS title, NULL::VARCHAR AS description,
      {S.LANGUAGE} AS language, {S.collapse(S.SNIPPET, 500)} AS text_snippet,
      CASE WHEN {S.LANGUAGE} IN ('en', 'fr', 'de') THEN '2024-01-01 00:00:00.000000' ELSE '2024-02-01 00:00:00.000000' END AS created_at FROM mk""",
    "upsert_artifacts": f"""WITH {S.CANONICAL_PAGES} SELECT sha256(nu) AS url_id, 'job-2/' || sha256(nu) || '.html' AS storage_key, sha256(html) AS checksum,
      octet_length(encode(html))::BIGINT AS size_bytes, CASE WHEN octet_length(encode(html)) > 10000 THEN 201::BIGINT ELSE 200::BIGINT END AS http_status FROM cpages""",
    "status_current": f"WITH {_TRANS} SELECT job_id, normalized_url, status, error, checkpoint FROM cur",
    "status_merge": f"""WITH {_TRANS} SELECT job_id, normalized_url, CASE WHEN job_id % 2 = 0 THEN 2::BIGINT ELSE 0::BIGINT END AS depth, status,
      coalesce(error, CASE WHEN job_id % 2 = 0 THEN 'base' END) AS error, checkpoint, {S.stamp('updated_at')} AS updated_at FROM cur""",
}
