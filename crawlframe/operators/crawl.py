"""Frontier, robots filter, politeness schedule, fetch outcomes and status transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions.lang import unnest
from crawlframe.functions.robots import allowed_by, request_target, rules_for
from crawlframe.functions.urls import domain_of, keep_allowed, netloc_of, normalize_url, normalize_urls, url_key
from crawlframe.operators.dedup import earliest
from crawlframe.operators.ordered import CHUNK, before, by_position, count_before, join_carry
from crawlframe.session import durable, small_or_shuffled

FAN_OUT = 50


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``reason`` to job requests: null for a valid one, else the broken rule."""
    seeds = F.coalesce(F.size("seed_urls"), F.lit(0))
    domains = F.coalesce(F.size("allowed_domains"), F.lit(0))
    incremental = F.coalesce(F.col("incremental"), F.lit(False))
    depth = F.coalesce(F.col("max_depth"), F.lit(1))
    hours = F.coalesce(F.col("recrawl_stale_hours"), F.lit(24))
    return requests.withColumn(
        "reason",
        F.when((depth < 0) | (depth > 10), "max_depth outside 0..10")
        .when((hours < 1) | (hours > 720), "recrawl_stale_hours outside 1..720")
        .when(~incremental & (seeds == 0), "seed_urls required unless incremental")
        .when(incremental & (seeds == 0) & (domains == 0), "allowed_domains required for incremental jobs"),
    )


def reject_empty(requests: DataFrame, frontier: DataFrame) -> DataFrame:
    """Valid requests with the number of queued URLs; none queued is a rejection."""
    queued = frontier.groupBy("job_id").agg(F.count("*").alias("urls_queued"))
    return requests.join(queued, "job_id", "left").withColumns({
        "urls_queued": F.coalesce("urls_queued", F.lit(0)),
        "reason": F.coalesce("reason", F.when(F.col("urls_queued").isNull(), F.lit("no URLs queued for crawl"))),
    })


def seed_frontier(jobs: DataFrame) -> DataFrame:
    """Seeds of every job -> distinct depth-0 frontier rows.

    A job without allowed domains takes the domains of its seeds.
    """
    default = F.transform(normalize_urls(F.col("seed_urls")), domain_of)
    given = F.coalesce(F.size("allowed_domains"), F.lit(0)) > 0
    rows = jobs.select(
        "job_id", "max_depth",
        F.when(given, F.col("allowed_domains")).otherwise(default).alias("allowed_domains"),
        F.posexplode("seed_urls").alias("pos", "url"),
    ).withColumn("normalized_url", normalize_url("url"))
    first = earliest(rows, ["job_id", "normalized_url"], ["pos"])
    return first.select(
        "job_id", "url", "normalized_url", url_key(F.col("normalized_url")).alias("url_key"),
        F.lit(0).alias("depth"), "max_depth", "allowed_domains", F.lit(False).alias("force_recrawl"),
    )


def stale(urls: DataFrame, now: Column, hours: Column) -> DataFrame:
    """URLs never crawled or last crawled more than ``hours`` ago."""
    cutoff = now - F.make_dt_interval(hours=hours)
    return urls.filter(F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < cutoff))


def incremental_frontier(jobs: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """Stale known URLs of each incremental job's domains, to be crawled by force."""
    wanted = small_or_shuffled(
        jobs.select(
            "job_id", "max_depth", "allowed_domains", "recrawl_stale_hours",
            F.explode(F.array_distinct("allowed_domains")).alias("domain"),
        )
    )
    due = stale(urls.drop("job_id").join(wanted, "domain"), now, F.col("recrawl_stale_hours"))
    return due.select(
        "job_id", F.col("canonical_url").alias("url"), "normalized_url",
        url_key(F.col("normalized_url")).alias("url_key"), "depth", "max_depth", "allowed_domains",
        F.lit(True).alias("force_recrawl"),
    ).dropDuplicates(["job_id", "url_key"])


def first_links(edges: DataFrame, per_page: int = FAN_OUT) -> DataFrame:
    """The first links of each source by position, repeated targets not counted twice."""
    first_seen = edges.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    rank = Window.partitionBy("src").orderBy("pos", "dst")
    return first_seen.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= per_page).drop("_n")


def expand_frontier(seeds: DataFrame, links: DataFrame, max_depth: int, keys: list[str] | None = None,
                    url: str = "normalized_url") -> DataFrame:
    """Breadth-first expansion: every reached (job, URL) with its smallest depth.

    ``links`` has one row per edge (src, dst). Each level is one join and one anti-join, written
    to the shared checkpoint folder; the loop ends at an empty level.
    """
    keys = ["job_id"] if keys is None else keys
    links = durable(links.select("src", "dst"))
    level = durable(seeds.select(*keys, url).distinct().withColumn("depth", F.lit(0)))
    seen = level
    for depth in range(1, max_depth + 1):
        nxt = (
            level.join(links, F.col(url) == F.col("src"))
            .select(*keys, F.col("dst").alias(url)).distinct()
            .join(seen.select(*keys, url), [*keys, url], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        level = durable(nxt)
        if not level.head(1):
            break
        seen = seen.unionByName(level)
    return seen


def expand_corpus(seeds: DataFrame, outlinks: DataFrame, per_page: int = FAN_OUT) -> DataFrame:
    """Crawl a corpus from seed rows (job_id, normalized_url, max_depth, allowed_domains).

    ``outlinks`` has one row per page with its link array, so a page that many jobs reach is split
    by the skew join without being copied many times. Links pass the job's domain filter, then the
    per-page limit, then the seen check.
    """
    policy = ["job_id", "max_depth", "allowed_domains"]
    level = durable(
        seeds.select(*policy, "normalized_url").dropDuplicates(["job_id", "normalized_url"])
        .withColumn("depth", F.lit(0))
    )
    seen = level.select("job_id", "normalized_url", "depth")
    deepest = level.agg(F.max("max_depth").alias("d")).first()["d"] or 0
    pages = durable(outlinks.select(F.col("normalized_url").alias("_src"), "extracted_links"))
    for _ in range(deepest):
        links = F.slice(keep_allowed(F.col("extracted_links"), F.col("allowed_domains")), 1, per_page)
        nxt = (
            level.filter(F.col("depth") < F.col("max_depth"))
            .join(pages, F.col("normalized_url") == F.col("_src"))
            .transform(unnest, links, "link", keep=[*policy, (F.col("depth") + 1).alias("depth")])
            .withColumn("normalized_url", normalize_url("link"))
            .dropDuplicates(["job_id", "normalized_url"])
            .join(seen.select("job_id", "normalized_url"), ["job_id", "normalized_url"], "left_anti")
            .select(*policy, "normalized_url", "depth")
        )
        level = durable(nxt)
        if not level.head(1):
            break
        seen = seen.unionByName(level.select("job_id", "normalized_url", "depth"))
    return seen


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Add ``allowed``: the verdict of the site's robots.txt, true for a site without one.

    ``robots`` has one row (site, robots_txt) per authority.
    """
    rules = robots.select(F.lower("site").alias("_site"), rules_for(F.col("robots_txt"), agent).alias("_rules"))
    return (
        urls.withColumn("_site", F.lower(netloc_of(F.col(url)))).join(rules, "_site", "left")
        .withColumn("allowed", F.coalesce(allowed_by(F.col("_rules"), request_target(F.col(url))), F.lit(True)))
        .drop("_site", "_rules")
    )


def politeness(arrivals: DataFrame, domain: str, ts: str, order: list[str], rate: float = 1.0,
               burst: int = 5) -> DataFrame:
    """Earliest dispatch time of every request under a token bucket per domain.

    With n the arrival number and g = 1/rate, a request leaves at the later of its arrival and
    max over earlier arrivals of (t - (n-1)g), plus (n - burst)g. Both running values are carried
    across chunks by position, so a busy domain spreads over tasks, also the requests of one instant.
    """
    g = 1_000_000.0 / rate
    keys = [domain]
    rows = by_position(arrivals.withColumn("_t", F.unix_micros(F.col(ts)).cast("double")), keys, [ts, *order])
    inside = Window.partitionBy(domain, CHUNK).orderBy(ts, *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_n", F.row_number().over(inside)).withColumn("_h", F.col("_t") - (F.col("_n") - 1) * g)
    local = local.withColumn("_m", F.max("_h").over(upto))
    summary = (
        local.groupBy(domain, CHUNK).agg(F.count("*").alias("_rows"), F.max("_h").alias("_peak"))
        .withColumn("_skip", F.coalesce(F.sum("_rows").over(before(keys)), F.lit(0)))
        .withColumn("_head", F.max(F.col("_peak") - F.col("_skip") * g).over(before(keys)))
        .select(domain, CHUNK, "_skip", "_head")
    )
    n = F.col("_skip") + F.col("_n")
    head = F.greatest(F.col("_head"), F.col("_m") - F.col("_skip") * g)
    ready = F.greatest(F.col("_t"), head + (n - burst) * g)
    wait = (F.coalesce(ready, F.col("_t")) - F.col("_t")) / 1_000_000
    return (
        join_carry(local, summary, keys)
        .withColumns({"arrival_no": n, "wait_seconds": wait})
        .withColumn("dispatch_at", F.timestamp_micros((F.col("_t") + F.col("wait_seconds") * 1_000_000).cast("long")))
        .drop(CHUNK, "_t", "_n", "_h", "_m", "_skip", "_head")
    )


def rate_limit_waits(schedule: DataFrame, domain: str, least_seconds: float = 0.01) -> DataFrame:
    """Number of waits per domain."""
    return schedule.filter(F.col("wait_seconds") > least_seconds).groupBy(domain).agg(F.count("*").alias("waits"))


def fetch_outcomes(log: DataFrame) -> DataFrame:
    """Classify each fetch by the first rule that applies.

    The log carries the flags is_duplicate, is_claimed, allowed and the columns http_status,
    checksum, stored_hash, storage_key.
    """
    unchanged = (F.col("stored_hash") != "") & (F.col("stored_hash") == F.col("checksum"))
    bad = F.col("http_status") >= 400
    outcome = (
        F.when(F.col("is_duplicate"), "duplicate")
        .when(F.col("is_claimed"), "skipped")
        .when(~F.col("allowed"), "skipped")
        .when(bad, "failed")
        .when(unchanged, "skipped")
        .otherwise("fetched")
    )
    error = (
        F.when(F.col("is_duplicate") | F.col("is_claimed"), F.lit(None).cast("string"))
        .when(~F.col("allowed"), "robots_disallowed")
        .when(bad, F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
    )
    done = ~F.col("is_duplicate") & ~F.col("is_claimed") & F.col("allowed") & ~bad
    checkpoint = F.when(
        done & unchanged, F.create_map(F.lit("reason"), F.lit("unchanged"), F.lit("checksum"), F.col("checksum"))
    ).when(
        done, F.create_map(F.lit("storage_key"), F.col("storage_key"), F.lit("checksum"), F.col("checksum"))
    )
    return log.withColumns({"outcome": outcome, "error": error, "checkpoint": checkpoint})


def assign_round_robin(requests: DataFrame, pool: list[str], lane: list[str], order: list[str],
                       ts: str, failed: Column | None = None) -> DataFrame:
    """Give each request the next pool member of its lane; a failed request skips one more."""
    if not pool:
        return requests.withColumn("proxy", F.lit(None).cast("string"))
    used = F.lit(1) if failed is None else F.when(failed, 2).otherwise(1)
    chunked = by_position(requests, lane, [ts, *order])
    turned = count_before(chunked, lane, [ts, *order], used, "_turn")
    members = F.array(*[F.lit(p) for p in pool])
    return turned.withColumn("proxy", F.element_at(members, (F.col("_turn") % len(pool)).cast("int") + 1)).drop("_turn", CHUNK)


def current_status(transitions: DataFrame, order: list[str], ts: str | None = None) -> DataFrame:
    """Last status per (job, URL); error and checkpoint keep their last non-null value.

    With a time column the time of the last change is added as updated_at.
    """
    at = F.struct(*order)

    def sticky(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), at)).alias(name)

    return transitions.groupBy("job_id", "normalized_url").agg(
        F.max_by("status", at).alias("status"), sticky("error"), sticky("checkpoint"),
        *([F.max(ts).alias("updated_at")] if ts else []),
    )


def lifecycle_rank(status: Column) -> Column:
    """Place of a status in the life of a URL; final ones share the last place."""
    return F.when(status == "queued", 0).when(status == "claimed", 1).when(status == "fetched", 2).otherwise(3)


def apply_transitions(job_urls: DataFrame, transitions: DataFrame, order: list[str], ts: str) -> DataFrame:
    """Merge transitions into the per-job URL table.

    At one time the later place in the life cycle wins, so that a late "fetched" does not undo "parsed"; a transition older
    than the row changes nothing but empty errors and checkpoints. An unknown row is created at the smallest depth that its
    transitions tell, else 0.
    """
    ranked = transitions.withColumn("_rank", lifecycle_rank(F.col("status")))
    latest = current_status(ranked, [ts, "_rank", *order], ts)
    if "depth" in transitions.columns:
        depth = transitions.groupBy("job_id", "normalized_url").agg(F.min("depth").alias("depth"))
        latest = latest.join(depth, ["job_id", "normalized_url"])
    else:
        latest = latest.withColumn("depth", F.lit(0))
    joined = job_urls.alias("o").join(
        latest.alias("n"),
        (F.col("o.job_id") == F.col("n.job_id")) & (F.col("o.normalized_url") == F.col("n.normalized_url")),
        "full_outer",
    )
    place = lambda side: F.struct(F.col(f"{side}.updated_at"), lifecycle_rank(F.col(f"{side}.status")))
    newer = F.col("n.job_id").isNotNull() & (F.col("o.job_id").isNull() | F.col("o.updated_at").isNull() | (place("n") >= place("o")))

    def column(name: str) -> Column:
        old = F.col(f"o.{name}")
        if name in ("job_id", "normalized_url"):
            return F.coalesce(old, F.col(f"n.{name}")).alias(name)
        if name in ("status", "updated_at"):
            return F.when(newer, F.coalesce(F.col(f"n.{name}"), old)).otherwise(old).alias(name)
        if name in ("error", "checkpoint"):
            return F.when(newer, F.coalesce(F.col(f"n.{name}"), old)).otherwise(F.coalesce(old, F.col(f"n.{name}"))).alias(name)
        if name == "depth":
            return F.coalesce(old, F.col("n.depth"), F.lit(0)).alias(name)
        return old.alias(name)

    return joined.select(*[column(c) for c in job_urls.columns])


def queue_and_apply(job_urls: DataFrame, changes: DataFrame, ts: str) -> DataFrame:
    """Apply transitions; a "queued" one only adds the row of a URL that the job does not know."""
    moved = apply_transitions(job_urls, changes.where("status <> 'queued'"), [], ts)
    queued = changes.where("status = 'queued'").groupBy("job_id", "normalized_url").agg(
        F.min("depth").alias("depth"), F.first("status").alias("status"), F.min(ts).alias("updated_at"))
    new = queued.join(moved.select("job_id", "normalized_url"), ["job_id", "normalized_url"], "left_anti")
    return moved.unionByName(new, allowMissingColumns=True)
