"""Streams over the given tables, run to the end of the data; most equal a batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.functions.urls import domain_of, normalize_url
from crawlframe.operators import dedup
from crawlframe.operators.corpus import clean_pages, extract_pages
from crawlframe.operators.merge import upsert_pages, url_id
from crawlframe.plans import bindings as B
from crawlframe.plans import crawl_queries, state_queries
from crawlframe.plans import sql_text as S
from crawlframe.plans.bindings import flat
from crawlframe.schemas import PAGES
from crawlframe.session import run_folder
from crawlframe.sources.events import RECORD, decode
from crawlframe.sources.snapshots import Snapshot
from crawlframe.sources.tables import read_table
from crawlframe.streaming import keyed, stages
from crawlframe.streaming.runtime import collect_stream, run_available, table_stream


def _events(spark, d):
    e = table_stream(spark, d, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("int")})


def stream_ledger(spark, d):
    e = _events(spark, d).select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("ref"), F.lit("crawler").alias("stage"))
    log = collect_stream(e.dropDuplicates(["ref", "stage"]), run_folder(spark, "ledger"))
    return log.read(spark).select("ref", "stage")


def stream_ttl_claims(spark, d):
    claims = keyed.claims_stream(_events(spark, d), "user_id", "ts", dedup.HOUR)
    return flat(collect_stream(claims, run_folder(spark, "claims")).read(spark).select("user_id", "ts"))


def stream_ttl_claims_forced(spark, d):
    claims = keyed.claims_stream(_events(spark, d), "user_id", "ts", dedup.DAY, F.col("event_type") == "purchase")
    return flat(collect_stream(claims, run_folder(spark, "claims")).read(spark).select("user_id", "ts", "forced"))


def stream_rate_5m(spark, d):
    e = _events(spark, d).withWatermark("ts", "10 minutes")
    counted = e.groupBy("event_type", F.window("ts", "5 minutes", "1 minute")).agg(F.count("*").alias("events"))
    rows = counted.select("event_type", F.col("window.end").alias("window_end"), "events", (F.col("events") / 300).alias("rate"))
    log = collect_stream(rows, run_folder(spark, "rates"), mode="update")
    out = log.latest(spark, ["event_type", "window_end"])
    return flat(out.select("event_type", "window_end", "events", F.round("rate", 6).alias("rate")))


def stream_politeness(spark, d):
    waits = keyed.politeness_stream(_events(spark, d), "user_id", "ts", "event_id", rate=1 / 36000, burst=2)
    return collect_stream(waits, run_folder(spark, "waits")).read(spark).select(F.col("seq").alias("event_id"), "user_id", "wait_us")


def stream_dlq_replay(spark, d):
    e = _events(spark, d)
    key = F.when(F.col("event_type") == "purchase", "unknown").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    letters = e.select(key.alias("event_id"), F.col("event_id").alias("seq"), "ts")
    return collect_stream(keyed.replay_stream(letters, "ts"), run_folder(spark, "replays")).read(spark).select("seq", "event_id", "replay_no")


def _records(spark, d):
    """Events as discovered-URL records: errors are cut JSON, signups lack their URL."""
    e = _events(spark, d)
    url = F.concat(F.lit("http://h/"), F.col("k").cast("string"))
    good = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("job_id"),
        url.alias("url"), F.when(F.col("event_type") != "signup", url).alias("normalized_url"), F.col("k").alias("depth")))
    value = F.when(F.col("event_type") == "error", F.substring(good, 1, 20)).otherwise(good)
    header = F.array(F.struct(F.lit("trace_id").alias("key"), F.encode(F.col("event_type"), "UTF-8").alias("value")))
    return e.select(F.lit("url.discovered").alias("topic"), F.col("event_id").cast("string").alias("key"),
                    value.alias("value"), header.cast(RECORD["headers"].dataType).alias("headers"))


def stream_quarantine(spark, d):
    _, bad = decode(_records(spark, d), "url.discovered")
    return collect_stream(bad, run_folder(spark, "quarantine")).read(spark).select("key", "problem")


def stream_decode(spark, d):
    good, _ = decode(_records(spark, d), "url.discovered")
    rows = good.select("event_id", "trace_id", "job_id", "normalized_url", "attempt", "schema_version", "depth", "max_depth",
                       F.size("allowed_domains").alias("domains"), "force_recrawl")
    return flat(collect_stream(rows, run_folder(spark, "decode")).read(spark).drop("batch"))


def stream_upsert_pages(spark, d):
    """Cleaned pages merged into a table in buckets, batch by batch: content of the last writer, id and time of the first."""
    p = table_stream(spark, d, "pages").withColumn("normalized_url", normalize_url("url"))
    rows = clean_pages(extract_pages(p)).withColumns({
        "url_id": url_id(F.col("normalized_url")), "id": F.col("page_id").cast("string"), "created_at": F.timestamp_seconds("page_id")})
    folder = run_folder(spark, "pages")
    table = Snapshot(f"{folder}/table", ["url_id"], PAGES, 16)

    def each(batch, batch_id):
        batch = batch.persist()
        table.merge(batch, lambda old, new: upsert_pages(old, new, ["page_id"]), "pages", batch_id)
        batch.unpersist()

    run_available(rows, f"{folder}/checkpoint", each)
    return flat(table.read(spark).select(
        "url_id", "id", "title", "language", "text_snippet", F.size("extracted_links").alias("link_count"), F.size("metadata").alias("metadata"), "created_at"))


def _kept(df, label):
    """The frame, written once: every batch of a crawl reads it again."""
    path = run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _crawl(spark, d, seeds, jobs, corpus=None, **how):
    work = stages.Work(spark, run_folder(spark, "stages"))
    if corpus is None:
        chosen = _kept(B.canonical_pages(spark, d).select("page_id", "normalized_url"), "canonical-pages")
        html = B.html_on_demand(chosen, read_table(spark, d, "pages"))
        corpus = lambda wanted: html(wanted).withColumn("http_status", F.lit(200))
    stages.seed(work, jobs, seeds.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")))
    stages.drain(work, corpus, **how)
    return work


def _jobs(seeds, depth):
    none = lambda kind: F.lit(None).cast(kind)
    return seeds.groupBy(F.col("job_id").alias("id")).agg(F.collect_list("url").alias("seed_urls")).select(
        "id", "seed_urls", F.lit(depth).alias("max_depth"), none("array<string>").alias("allowed_domains"), F.lit("running").alias("status"),
        F.lit(0).alias("urls_queued"), none("timestamp").alias("created_at"), none("timestamp").alias("updated_at"))


def stream_stages(spark, d):
    """Every page as a seed of one job, through crawl, parse and clean."""
    seeds = B.pages(spark, d).select(
        F.lit("job").alias("job_id"), "url", normalize_url("url").alias("normalized_url"), F.lit(0).alias("max_depth"),
        F.array().cast("array<string>").alias("allowed_domains"))
    work = _crawl(spark, d, seeds, _jobs(seeds.limit(1), 0), retries=False)
    pages, urls = work.tables["pages"].read(spark), work.tables["urls"].read(spark)
    out = pages.join(urls.select(F.col("id").alias("url_id"), "normalized_url", F.col("content_hash").alias("checksum")), "url_id")
    return flat(out.select("normalized_url", "title", "language", "text_snippet", "checksum", F.size("extracted_links").alias("link_count")))


def stream_crawl(spark, d):
    """Parts and suppliers as pages that link to one another; one job starts at the parts numbered like nations, two levels deep."""
    links = B.link_table(spark, d).groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    anchor = lambda e: F.concat(F.lit('<a href="/'), e["dst"], F.lit('">x</a>'))
    corpus = links.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("e")).select(
        F.concat(F.lit("http://shop.example.com/"), "src").alias("normalized_url"), F.lit(200).alias("http_status"),
        F.concat(F.lit("<title>"), F.col("src"), F.lit("</title>"), F.array_join(F.transform("e", anchor), " ")).alias("html"))
    n = read_table(spark, d, "nation")
    url = F.concat(F.lit("http://shop.example.com/p"), F.col("n_nationkey").cast("string"))
    seeds = n.select(F.lit("job").alias("job_id"), url.alias("url"), url.alias("normalized_url"), F.lit(2).alias("max_depth"),
                     F.array(F.lit("shop.example.com")).alias("allowed_domains"))
    work = _crawl(spark, d, seeds, _jobs(seeds, 2), corpus, retries=False)
    return flat(work.tables["job_urls"].read(spark).select("job_id", "normalized_url", "depth", "status", "error"))


def stream_job_status(spark, d):
    """Every site is a job that starts at its page of the smallest id, one level deep: counts kept by moves between states."""
    named = B.canonical_pages(spark, d).withColumn("job_id", domain_of(F.col("normalized_url")))
    first = dedup.earliest(named, ["job_id"], ["page_id"])
    seeds = _kept(first.select("job_id", "url", "normalized_url", F.lit(1).alias("max_depth"), F.array("job_id").alias("allowed_domains")), "seeds")
    work = _crawl(spark, d, seeds, _jobs(seeds, 1), robots=_kept(B.robots(spark, d), "robots"), agent=crawl_queries.AGENT, retries=False)
    counts = work.tables["job_counts"].read(spark).select("job_id", "parsed", "skipped", "failed", (F.col("queued") + F.col("claimed") + F.col("fetched")).alias("open"))
    jobs = work.tables["jobs"].read(spark).select(F.col("id").alias("job_id"), "status", "urls_queued")
    return flat(jobs.join(counts, "job_id", "left"))


QUERIES = {f.__name__: f for f in (
    stream_ledger, stream_ttl_claims, stream_ttl_claims_forced, stream_rate_5m, stream_politeness, stream_dlq_replay,
    stream_quarantine, stream_decode, stream_upsert_pages, stream_stages,
    stream_crawl, stream_job_status,
)}

_PAGES = f"""WITH {S.LINKS}, {S.CANONICAL_PAGES}, li AS (SELECT page_id, count(*) AS n FROM links GROUP BY 1)
  SELECT nu AS normalized_url, {S.collapse(S.TITLE, 1024)} AS title, {S.LANGUAGE} AS language, {S.collapse(S.SNIPPET, 500)} AS text_snippet,
  coalesce(n, 0) AS link_count/*more*/ FROM mk JOIN (SELECT page_id, nu FROM cpages) USING (page_id) LEFT JOIN li USING (page_id)"""

#: Robots rules stop a page and its links; a URL without a page fails.
_SITES = f"""{S.LINKS}, {crawl_queries._ROBOTS},
seed AS (SELECT {S.host('nu')} AS job, nu, page_id FROM cpages QUALIFY row_number() OVER (PARTITION BY {S.host('nu')} ORDER BY page_id) = 1),
found AS (SELECT DISTINCT job, dst FROM seed JOIN verdict USING (page_id) JOIN links USING (page_id) WHERE allowed AND pos < 50 AND {S.host('dst')} = job AND dst <> nu),
reach AS (SELECT job, dst, coalesce(arg_min(allow, n), true) AS allowed FROM found LEFT JOIN rules
  ON job = site AND starts_with(regexp_extract(dst, '^[a-z]+://[^/]*(/.*)$', 1), path) GROUP BY ALL),
state AS (SELECT job, CASE WHEN allowed THEN 'parsed' ELSE 'skipped' END AS status FROM seed JOIN verdict USING (page_id)
  UNION ALL SELECT job, CASE WHEN NOT allowed THEN 'skipped' WHEN dst IN (SELECT nu FROM cpages) THEN 'parsed' ELSE 'failed' END FROM reach)"""

ORACLE = {
    "stream_ledger": f"WITH {S.EVENTS} SELECT DISTINCT user_id || ':' || k AS ref, 'crawler' AS stage FROM ev",
    "stream_ttl_claims": state_queries.ORACLE["ttl_claims"],
    "stream_ttl_claims_forced": state_queries.ORACLE["ttl_claims_forced"],
    "stream_rate_5m": crawl_queries.ORACLE["rate_5m"],
    "stream_politeness": "SELECT event_id, user_id, wait_us FROM (" + crawl_queries.ORACLE["politeness_schedule"] + ")",
    "stream_dlq_replay": crawl_queries.ORACLE["dlq_replay_cap"],
    "stream_quarantine": """SELECT event_id::VARCHAR AS key, CASE event_type WHEN 'error' THEN 'unreadable' ELSE 'missing normalized_url' END AS problem
      FROM events WHERE event_type IN ('error', 'signup')""",
    "stream_decode": f"""WITH {S.EVENTS} SELECT event_id::VARCHAR AS event_id, event_type AS trace_id, user_id::VARCHAR AS job_id, 'http://h/' || k AS normalized_url,
      1::BIGINT AS attempt, 1::BIGINT AS schema_version, k::BIGINT AS depth, 1::BIGINT AS max_depth, 0::BIGINT AS domains, false AS force_recrawl
      FROM ev WHERE event_type NOT IN ('error', 'signup')""",
    "stream_upsert_pages": f"""WITH {S.LINKS}, {S.canonical('cp', 'pages', 'url')}, li AS (SELECT page_id, count(*) AS n FROM links GROUP BY 1),
      w AS (SELECT nu, min(page_id) AS first, max(page_id) AS last FROM cp GROUP BY 1)
      SELECT substr(sha256('url:' || nu), 1, 32) AS url_id, first::VARCHAR AS id, {S.collapse(S.TITLE, 1024)} AS title, {S.LANGUAGE} AS language,
      {S.collapse(S.SNIPPET, 500)} AS text_snippet, coalesce(n, 0) AS link_count, 0::BIGINT AS metadata, {S.stamp("(to_timestamp(first) AT TIME ZONE 'UTC')")} AS created_at
      FROM w JOIN mk ON page_id = last LEFT JOIN li ON li.page_id = last""",
    "stream_stages": _PAGES.replace("/*more*/", ", sha256(html) AS checksum"),
    "stream_crawl": f"""WITH RECURSIVE {crawl_queries._LINKS}, b AS (SELECT 'p' || n_nationkey AS u, 0::BIGINT AS depth FROM nation
      UNION SELECT dst, depth + 1 FROM b JOIN top ON src = u WHERE depth < 2),
      m AS (SELECT u, min(depth) AS depth FROM b GROUP BY 1)
      SELECT 'job' AS job_id, 'http://shop.example.com/' || u AS normalized_url, depth, CASE WHEN has THEN 'parsed' ELSE 'failed' END AS status,
      CASE WHEN NOT has THEN 'no response' END AS error FROM (SELECT u, depth, u IN (SELECT src FROM top) AS has FROM m)""",
    "stream_job_status": f"""WITH {_SITES} SELECT job AS job_id, 'completed' AS status, count(*) AS urls_queued, count(*) FILTER (status = 'parsed') AS parsed,
      count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS open FROM state GROUP BY 1""",
}
