"""Frontier, robots, politeness, outcome, failure and metric queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.functions.html import page_links, visible_markup
from crawlframe.functions.text import trace_context
from crawlframe.operators import crawl, dedup, metrics, retry, traces
from crawlframe.plans import bindings as B
from crawlframe.plans import sql_text as S
from crawlframe.plans.bindings import flat
from crawlframe.sources.tables import read_table

AGENT = "crawlframe/1.0"
POOL = ["http://a.proxy:1", "http://b.proxy:2", "http://c.proxy:3"]


def _micros(seconds):
    return F.round(F.col(seconds) * 1_000_000).cast("bigint")


def request_validation(spark, d):
    """Customers as job requests."""
    c = read_table(spark, d, "customer")
    nation = F.col("c_nationkey")
    none = F.array().cast("array<string>")
    requests = c.select(
        F.col("c_custkey").alias("job_id"),
        F.when(nation % 3 == 0, none).otherwise(F.array(F.col("c_name"))).alias("seed_urls"),
        (nation - 5).alias("max_depth"),
        F.when(nation % 2 == 0, none).otherwise(F.array(F.lit("example.com"))).alias("allowed_domains"),
        (F.col("c_mktsegment") == "BUILDING").alias("incremental"),
        F.pmod(F.col("c_custkey"), F.lit(900)).cast("int").alias("recrawl_stale_hours"),
    )
    return crawl.validate_requests(requests).select("job_id", "reason")


def seed_frontier(spark, d):
    """Pages as seeds, each also with a fragment; a job is ten neighbouring page ids."""
    p = read_table(spark, d, "pages")
    jobs = p.select(
        F.floor(F.col("page_id") / 10).alias("job_id"), F.lit(1).alias("max_depth"),
        F.array("url", F.concat(F.col("url"), F.lit("#again"))).alias("seed_urls"),
        F.lit(None).cast("array<string>").alias("allowed_domains"),
    )
    return flat(crawl.seed_frontier(jobs).select(
        "job_id", "normalized_url", "url_key", "depth", F.array_join(F.array_distinct("allowed_domains"), ",").alias("domains")))


def incremental_frontier(spark, d):
    """Every host of the corpus as the domain of one job; its length gives the staleness."""
    hosts = B.urls(spark, d).select("domain").distinct()
    jobs = hosts.select(
        F.concat(F.lit("job-"), F.col("domain")).alias("job_id"), F.lit(1).alias("max_depth"),
        F.array("domain").alias("allowed_domains"), (F.length("domain") * 24).alias("recrawl_stale_hours"),
    )
    out = crawl.incremental_frontier(jobs, B.urls(spark, d), B.now())
    return flat(out.select("job_id", "normalized_url", "depth", "force_recrawl"))


def first_links(spark, d):
    return flat(crawl.first_links(B.link_table(spark, d)))


def frontier_bfs(spark, d):
    """Five jobs (regions) start at the parts numbered like their nations."""
    n = read_table(spark, d, "nation")
    seeds = n.select(F.col("n_regionkey").alias("job_id"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("normalized_url"))
    links = crawl.first_links(B.link_table(spark, d), crawl.FAN_OUT)
    return flat(crawl.expand_frontier(seeds, links, 3))


def frontier_corpus(spark, d):
    """Every page as a seed of one of ten jobs; links stay inside the parent domain."""
    p = B.canonical_pages(spark, d, page_links(visible_markup(F.col("html")), F.col("url")).alias("extracted_links"))
    seeds = p.select(
        (F.col("page_id") % 10).alias("job_id"), "normalized_url", F.lit(1).alias("max_depth"),
        F.array(F.lit("example.com"), F.lit("example.org")).alias("allowed_domains"),
    )
    reached = crawl.expand_corpus(seeds, p.select("normalized_url", "extracted_links"))
    return flat(reached)


def robots_filter(spark, d):
    out = crawl.robots_filter(B.pages(spark, d).select("page_id", "url"), B.robots(spark, d), AGENT)
    return out.select("page_id", "allowed")


def politeness_schedule(spark, d):
    out = crawl.politeness(B.events(spark, d), "user_id", "ts", ["event_id"], rate=1 / 36000, burst=2)
    return flat(out.select("event_id", "user_id", "arrival_no", _micros("wait_seconds").alias("wait_us")))


def politeness_by_type(spark, d):
    """Five busy domains, so that rows of one domain span many chunks."""
    out = crawl.politeness(B.events(spark, d), "event_type", "ts", ["event_id"], rate=1 / 1200, burst=5)
    return flat(out.select("event_id", _micros("wait_seconds").alias("wait_us")))


def rate_limit_waits(spark, d):
    out = crawl.politeness(B.events(spark, d), "user_id", "ts", ["event_id"], rate=1 / 36000, burst=2)
    return crawl.rate_limit_waits(out, "user_id")


def proxy_assignment(spark, d):
    failed = F.col("event_type") == "error"
    out = crawl.assign_round_robin(B.events(spark, d), POOL, ["user_id"], ["event_id"], "ts", failed)
    return out.select("event_id", "proxy")


def fetch_outcome(spark, d):
    """Every event as a fetch of the page numbered like its user; where there is none, the fetch fails."""
    return _fetch_outcome(spark, d, ["ref"], lambda log: dedup.claim_winners(log, "user_id", "ts", "event_id"))


def fetch_outcome_attempts(spark, d):
    """The same with signups as second attempts, which the ledger tells apart and no claim stops, and purchases as forced fetches."""
    return _fetch_outcome(spark, d, ["ref", "attempt"], lambda log: dedup.pass_claims(log, "user_id", "ts", "event_id", "attempt", "force", dedup.DAY))


def _fetch_outcome(spark, d, ledger_key, passing):
    e = B.events(spark, d).withColumns({
        "ref": F.concat_ws(":", F.col("user_id").cast("string"), F.col("k").cast("string")),
        "attempt": F.when(F.col("event_type") == "signup", 2).otherwise(1), "force": F.col("event_type") == "purchase",
    })
    first = dedup.earliest(e, ledger_key, ["ts", "event_id"]).select("event_id", F.lit(False).alias("is_duplicate"))
    log = e.join(first, "event_id", "left").withColumn("is_duplicate", F.col("is_duplicate").isNull())
    claims = passing(log.filter(~F.col("is_duplicate"))).withColumn("is_claimed", F.lit(False))
    log = log.join(claims, "event_id", "left").withColumn("is_claimed", F.col("is_claimed").isNull())

    pages = crawl.robots_filter(B.hashed_pages(spark, d, "job-1"), B.robots(spark, d), AGENT)
    pages = pages.select(
        F.col("page_id").alias("user_id"), "normalized_url", "checksum", "storage_key", "allowed",
        F.when(F.col("page_id") % 2 == 0, F.col("checksum")).alias("stored_hash"),
    )
    status = F.when(F.col("normalized_url").isNull(), 404).when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    fetched = log.join(pages, "user_id", "left").withColumns({"http_status": status, "allowed": F.coalesce("allowed", F.lit(True))})
    out = crawl.fetch_outcomes(fetched)
    return flat(out.select("event_id", "normalized_url", "outcome", "error", F.col("checkpoint")["reason"].alias("reason"), F.col("checkpoint")["storage_key"].alias("storage_key")))


def retry_decision(spark, d):
    out = retry.decide(B.failures(spark, d))
    return flat(out.select("event_id", "attempt", "should_retry", "delay_seconds", "reason"))


def failure_routing(spark, d):
    again, dead = retry.route(B.failures(spark, d))
    both = again.select("event_id", "stage", F.lit("url.failed").alias("topic")).unionByName(
        dead.select("event_id", "stage", F.lit("dlq").alias("topic")))
    return flat(both)


def retry_reemit(spark, d):
    again, _ = retry.route(B.failures(spark, d))
    return flat(retry.reemit(again).select("event_id", "topic", "attempt", "retry_at", "force_recrawl"))


def retry_outcomes(spark, d):
    out = retry.decide(B.failures(spark, d)).withColumn("result", F.when(F.col("should_retry"), "republished").otherwise("dlq"))
    return retry.outcome_counts(out, "stage", "result")


def dlq_replay_cap(spark, d):
    keyed = B.letters(spark, d).withColumn("event_id", F.coalesce(F.get_json_object("payload", "$.event_id"), F.lit("unknown")))
    return flat(retry.replay_numbers(keyed, "event_id", "ts", ["seq"]).select("seq", "event_id", "replay_no"))


def dlq_shape_route(spark, d):
    out = retry.replay(B.letters(spark, d), "ts", ["seq"])
    return flat(out.select("seq", "shape", "result", "topic", "force_recrawl"))


def dlq_outcomes(spark, d):
    return retry.outcome_counts(retry.replay(B.letters(spark, d), "ts", ["seq"]), "result")


def counter_by_label(spark, d):
    e = B.events(spark, d).withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("success"))
    return metrics.counters(e, "event_type", "status")


def duration_buckets(spark, d):
    return metrics.histogram(B.events(spark, d), "value", ["event_type"], metrics.CRAWL_BUCKETS)


def rate_5m(spark, d):
    out = metrics.rates(B.events(spark, d), "ts", ["event_type"])
    return flat(out.select("event_type", "window_end", "events", F.round("rate", 6).alias("rate")))


def p95_from_buckets(spark, d):
    out = metrics.window_quantile(B.events(spark, d), "ts", "value", ["event_type"], metrics.CRAWL_BUCKETS, minutes=5)
    return flat(out.select("event_type", "window_end", "observations", F.round("quantile", 6).alias("p95")))


def p95_exact(spark, d):
    out = metrics.exact_quantile(B.events(spark, d), "value", ["event_type"])
    return out.select("event_type", F.round("quantile", 6).alias("p95"))


def alert_intervals(spark, d):
    out = metrics.alerts(B.events(spark, d), "ts", 0.003, 2, ["event_type"])
    return flat(out.select("event_type", "breach_start", "fired_at", "breach_end", F.round("peak_rate", 6).alias("peak_rate")))


def alert_rules(spark, d):
    """The three alert rules over the failures of their stages."""
    e = B.events(spark, d)
    stages = {"crawl_errors": "error", "parser_errors": "view", "dead_letters": "click"}
    out = None
    for rule, (threshold, hold) in metrics.ALERT_RULES.items():
        one = metrics.alerts(e.filter(F.col("event_type") == stages[rule]), "ts", threshold, hold).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return flat(out.select("rule", "breach_start", "fired_at", "breach_end"))


def trace_ids(spark, d):
    raw = F.sha2(F.col("event_id").cast("string"), 256)
    e = B.events(spark, d).withColumn("trace_id", F.when(
        F.col("k") % 10 == 0, F.concat(F.substring(raw, 1, 8), F.lit("-xyz-"), F.substring(raw, 9, 8))
    ).otherwise(F.concat(F.substring(raw, 1, 8), F.lit("-"), F.substr(raw, F.lit(9), F.col("k") % 40))))
    ctx = trace_context(F.col("trace_id"))
    return e.select("event_id", ctx["trace"].alias("trace"), ctx["span"].alias("span"))


def _hops(spark, d):
    """The event log as the log of the stages: a user's events of five days are one trace; every tenth id is too short to be one."""
    raw = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.floor(F.dayofmonth("ts") / 5).cast("string")), 256)
    known = F.concat(F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 24))
    e = B.events(spark, d)
    stage = (
        F.when(F.col("event_type") == "click", "cleaner").when(F.col("event_type") == "view", "parser")
        .when(F.col("event_type") == "error", "retry").otherwise("crawler")
    )
    log = e.select("event_id", "ts", stage.alias("stage"), F.when(F.col("k") % 10 == 0, F.substring(raw, 1, 8)).otherwise(known).alias("id"))
    log = log.withColumn("trace", trace_context(F.col("id"))["trace"])
    return traces.trace_hops(log, "trace", "ts", "stage", "event_id", gap_seconds=86400)


def trace_hops(spark, d):
    return flat(_hops(spark, d).select("event_id", "trace", "stage", "hop", "from_stage", "latency_us", "is_gap", "is_backward"))


def trace_timelines(spark, d):
    out = traces.trace_timelines(_hops(spark, d), "trace", "ts", "stage")
    return flat(out.withColumns({"missing": F.array_join("missing", ","), "first_at": F.col("first_at").cast("timestamp"), "last_at": F.col("last_at").cast("timestamp")}))


QUERIES = {f.__name__: f for f in (
    request_validation, seed_frontier, incremental_frontier, first_links, frontier_bfs, frontier_corpus, robots_filter,
    politeness_schedule, politeness_by_type, rate_limit_waits, proxy_assignment, fetch_outcome, fetch_outcome_attempts, retry_decision,
    failure_routing, retry_reemit, retry_outcomes, dlq_replay_cap, dlq_shape_route, dlq_outcomes, counter_by_label,
    duration_buckets, rate_5m, p95_from_buckets, p95_exact, alert_intervals, alert_rules, trace_ids, trace_hops, trace_timelines,
)}

_FAIL = S.EVENTS + """,
fl AS (SELECT event_id, ts, k % 7 + 1 AS attempt, CASE event_type WHEN 'click' THEN 'cleaner' WHEN 'view' THEN 'parser' ELSE 'crawler' END AS stage,
  'HTTP ' || (400 + k) AS error, event_type = 'click' AND k % 2 = 0 AS has_payload, k % 3 = 0 AS force_recrawl FROM ev)"""
_LETTERS = S.EVENTS + """,
lt AS (SELECT event_id AS seq, ts, CASE WHEN event_type = 'purchase' THEN 'unknown' ELSE 'u' || user_id END AS event_id,
  CASE event_type WHEN 'click' THEN 'page' WHEN 'view' THEN 'url' WHEN 'purchase' THEN 'url' WHEN 'signup' THEN 'page' ELSE 'unrecognized' END AS shape,
  event_type FROM ev),
lg AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS s FROM lt WINDOW w AS (PARTITION BY event_id ORDER BY ts, seq)),
li AS (SELECT *, sum(s) OVER (PARTITION BY event_id ORDER BY ts, seq) AS island FROM lg),
ln AS (SELECT *, row_number() OVER (PARTITION BY event_id, island ORDER BY ts, seq) AS replay_no FROM li),
lr AS (SELECT *, CASE WHEN replay_no > 3 THEN 'cap_exceeded' WHEN shape = 'unrecognized' THEN 'unrecognized' WHEN event_type = 'signup' THEN 'error' ELSE 'success' END AS result FROM ln)"""
_LINKS = """
el AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_orderkey * 8 + l_linenumber AS pos FROM lineitem
  UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, l_orderkey * 8 + l_linenumber FROM lineitem),
fs AS (SELECT src, dst, min(pos) AS pos FROM el GROUP BY 1, 2),
top AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos, dst) <= 50)"""
_ROBOTS = S.CANONICAL_PAGES + f""",
sites AS (SELECT DISTINCT {S.host('nu')} AS site FROM cpages),
rules AS (SELECT site, 1 AS n, '/en/4' AS path, true AS allow FROM sites WHERE length(site) % 3 = 0
  UNION ALL SELECT site, 2, '/en/', false FROM sites WHERE length(site) % 3 = 0
  UNION ALL SELECT site, 1, '/fr', false FROM sites WHERE length(site) % 3 = 1
  UNION ALL SELECT site, 2, '/es/', false FROM sites WHERE length(site) % 3 = 1),
verdict AS (SELECT p.page_id, coalesce(arg_min(allow, n), true) AS allowed FROM pages p
  LEFT JOIN rules ON lower({S.host('p.url')}) = site AND starts_with(regexp_extract(p.url, '^[a-z]+://[^/]*(/.*)$', 1), path) GROUP BY 1)"""
_POLITE = """WITH n AS (SELECT *, row_number() OVER w AS n, epoch_us(ts) AS t FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
h AS (SELECT *, max(t - (n - 1) * {g}) OVER (PARTITION BY {key} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM n),
w AS (SELECT event_id, user_id, n AS arrival_no, greatest(t, coalesce(m + (n - 1) * {g} - ({b} - 1) * {g}, t)) - t AS wait FROM h)"""
_MIN = """WITH mn AS (SELECT event_type, date_trunc('minute', ts) AS m, value FROM events),
sl AS (SELECT event_type, m + to_minutes(i) AS window_end, value FROM mn, range(1, {k} + 1) r(i))"""
_BOUNDS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]


def _alert_sql(where: str, threshold: float, hold: int) -> str:
    return f"""SELECT event_type, min(window_end) AS breach_start, min(window_end) + INTERVAL {hold} MINUTE AS fired_at, max(window_end) AS breach_end,
      max(rate) AS peak_rate FROM (SELECT *, window_end - to_minutes(row_number() OVER (PARTITION BY event_type ORDER BY window_end)) AS island FROM
      (SELECT event_type, window_end, count(*) / 300 AS rate FROM sl WHERE {where} GROUP BY 1, 2 HAVING count(*) / 300 > {threshold}))
      GROUP BY event_type, island HAVING max(window_end) - min(window_end) >= INTERVAL {hold} MINUTE"""


def _quantile_sql() -> str:
    cum = ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(_BOUNDS))
    cases = " ".join(
        f"WHEN b{i} >= 0.95 * n THEN {_BOUNDS[i - 1] if i else 0.0} + ({b} - {_BOUNDS[i - 1] if i else 0.0}) * (0.95 * n - {f'b{i - 1}' if i else 0}) / (b{i} - {f'b{i - 1}' if i else 0})"
        for i, b in enumerate(_BOUNDS))
    return f"""{_MIN.format(k=5)}, hist AS (SELECT event_type, window_end, count(*) AS n, {cum} FROM sl GROUP BY 1, 2)
      SELECT event_type, {S.stamp('window_end')} AS window_end, n AS observations, round((CASE {cases} ELSE 60.0 END)::DOUBLE, 6) AS p95 FROM hist"""


_HOPS = S.EVENTS + """,
tl AS (SELECT event_id, ts, sha256(user_id || '|' || day(ts) // 5) AS h,
  CASE event_type WHEN 'click' THEN 'cleaner' WHEN 'view' THEN 'parser' WHEN 'error' THEN 'retry' ELSE 'crawler' END AS stage FROM ev WHERE k % 10 <> 0),
th AS (SELECT event_id, substr(h, 1, 32) AS trace, ts, stage, list_position(['crawler', 'parser', 'cleaner'], stage) AS p, row_number() OVER w AS hop,
  lag(stage) OVER w AS from_stage, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS latency_us FROM tl WINDOW w AS (PARTITION BY substr(h, 1, 32) ORDER BY ts, event_id)),
hops AS (SELECT *, coalesce(latency_us > 86400000000, false) AS is_gap,
  coalesce(p < list_position(['crawler', 'parser', 'cleaner'], from_stage), false) AS is_backward FROM th)"""


def _outcome_sql(ledger_key: str, bypass: str, forced: str) -> str:
    return _SQL_OUTCOME.format(ledger_key=ledger_key, bypass=bypass, forced=forced)


_SQL_OUTCOME = f"""WITH RECURSIVE {_ROBOTS}, {S.EVENTS},
""".replace("{", "{{").replace("}", "}}") + """
      ke AS (SELECT *, row_number() OVER (PARTITION BY {ledger_key} ORDER BY ts, event_id) > 1 AS dup FROM ev),
      sg AS (SELECT *, {bypass} AS bypass, count(*) FILTER ({forced}) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM ke WHERE NOT dup),
      nd AS (SELECT user_id, s, ts, min(event_id) AS id FROM sg WHERE NOT bypass GROUP BY 1, 2, 3),
      c AS (SELECT user_id, s, min(ts) AS ts FROM nd GROUP BY 1, 2 UNION ALL
        SELECT e.user_id, e.s, min(e.ts) FROM c JOIN nd e ON e.user_id = c.user_id AND e.s = c.s AND e.ts >= c.ts + INTERVAL 24 HOUR GROUP BY e.user_id, e.s, c.ts),
      won AS (SELECT nd.id FROM nd JOIN c ON c.user_id = nd.user_id AND c.s = nd.s AND c.ts = nd.ts UNION ALL SELECT event_id FROM sg WHERE bypass),
      lg AS (SELECT ke.*, won.id IS NULL AS claimed, coalesce(allowed, true) AS allowed, nu, cpages.page_id,
        CASE WHEN nu IS NULL THEN 404 WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 404 ELSE 200 END AS http
        FROM ke LEFT JOIN cpages ON cpages.page_id = ke.user_id LEFT JOIN verdict ON verdict.page_id = cpages.page_id LEFT JOIN won ON won.id = event_id),
      o AS (SELECT *, CASE WHEN dup THEN 1 WHEN claimed THEN 2 WHEN NOT allowed THEN 3 WHEN http >= 400 THEN 4 WHEN page_id % 2 = 0 THEN 5 ELSE 6 END AS rule FROM lg)
      SELECT event_id, nu AS normalized_url, ['duplicate', 'skipped', 'skipped', 'failed', 'skipped', 'fetched'][rule] AS outcome,
      CASE rule WHEN 3 THEN 'robots_disallowed' WHEN 4 THEN 'HTTP ' || http END AS error, CASE WHEN rule = 5 THEN 'unchanged' END AS reason,
      CASE WHEN rule = 6 THEN 'job-1/' || sha256(nu) || '.html' END AS storage_key FROM o"""

ORACLE = {
    "request_validation": """SELECT c_custkey AS job_id, CASE WHEN c_nationkey - 5 < 0 OR c_nationkey - 5 > 10 THEN 'max_depth outside 0..10'
      WHEN c_custkey % 900 < 1 OR c_custkey % 900 > 720 THEN 'recrawl_stale_hours outside 1..720'
      WHEN c_mktsegment <> 'BUILDING' AND c_nationkey % 3 = 0 THEN 'seed_urls required unless incremental'
      WHEN c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 0 AND c_nationkey % 2 = 0 THEN 'allowed_domains required for incremental jobs' END AS reason FROM customer""",
    "seed_frontier": f"""WITH {S.canonical('pc', 'pages', 'url')} SELECT DISTINCT page_id // 10 AS job_id, nu AS normalized_url, sha256(nu) AS url_key, 0::BIGINT AS depth, {S.host('nu')} AS domains FROM pc""",
    "incremental_frontier": f"""WITH {S.URLS} SELECT 'job-' || domain AS job_id, normalized_url, depth, true AS force_recrawl FROM urls
      WHERE last_crawled_at IS NULL OR last_crawled_at < {S.NOW} - to_hours(length(domain) * 24)""",
    "first_links": f"WITH {_LINKS} SELECT src, dst, pos FROM top",
    "frontier_bfs": f"""WITH RECURSIVE {_LINKS}, b AS (SELECT n_regionkey::BIGINT AS job_id, 'p' || n_nationkey AS normalized_url, 0::BIGINT AS depth FROM nation
      UNION SELECT job_id, dst, depth + 1 FROM b JOIN top ON src = normalized_url WHERE depth < 3)
      SELECT job_id, normalized_url, min(depth) AS depth FROM b GROUP BY 1, 2""",
    "frontier_corpus": f"""WITH {S.LINKS}, {S.CANONICAL_PAGES},
      kept AS (SELECT l.page_id, dst, row_number() OVER (PARTITION BY l.page_id ORDER BY pos) AS n FROM links l JOIN cpages USING (page_id)
        WHERE {S.host('dst')} IN ('example.com', 'example.org') OR ends_with({S.host('dst')}, '.example.com') OR ends_with({S.host('dst')}, '.example.org')),
      r AS (SELECT page_id % 10 AS job_id, nu AS normalized_url, 0::BIGINT AS depth FROM cpages UNION ALL SELECT page_id % 10, dst, 1 FROM kept WHERE n <= 50)
      SELECT job_id, normalized_url, min(depth) AS depth FROM r GROUP BY 1, 2""",
    "robots_filter": f"WITH {_ROBOTS} SELECT page_id, allowed FROM verdict",
    "politeness_schedule": _POLITE.format(key="user_id", g="36000000000::BIGINT", b=2) + " SELECT event_id, user_id, arrival_no, wait::BIGINT AS wait_us FROM w",
    "politeness_by_type": _POLITE.format(key="event_type", g="1200000000::BIGINT", b=5) + " SELECT event_id, wait::BIGINT AS wait_us FROM w",
    "rate_limit_waits": _POLITE.format(key="user_id", g="36000000000::BIGINT", b=2) + " SELECT user_id, count(*) AS waits FROM w WHERE wait > 10000 GROUP BY 1",
    "proxy_assignment": """SELECT event_id, ['http://a.proxy:1', 'http://b.proxy:2', 'http://c.proxy:3'][(coalesce(sum(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END)
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3)::INT + 1] AS proxy FROM events""",
    "fetch_outcome": _outcome_sql("user_id, k", "false", "false"),
    "fetch_outcome_attempts": _outcome_sql("user_id, k, event_type = 'signup'", "event_type IN ('signup', 'purchase')", "event_type = 'purchase'"),
    "retry_decision": f"""WITH {_FAIL} SELECT event_id, attempt::BIGINT AS attempt, attempt < 5 AS should_retry, CASE WHEN attempt < 5 THEN pow(2.0::DOUBLE, attempt - 1) ELSE 0.0::DOUBLE END AS delay_seconds,
      CASE WHEN attempt >= 5 THEN 'max attempts reached: ' || error ELSE error END AS reason FROM fl""",
    "failure_routing": f"WITH {_FAIL} SELECT event_id, stage, CASE WHEN attempt < 5 THEN 'url.failed' ELSE 'dlq' END AS topic FROM fl",
    "retry_reemit": f"""WITH {_FAIL} SELECT event_id, CASE WHEN has_payload THEN 'page.parsed' ELSE 'url.discovered' END AS topic, (attempt + 1)::BIGINT AS attempt,
      {S.stamp("ts + to_seconds(pow(2, attempt - 1)::INT)")} AS retry_at, force_recrawl FROM fl WHERE attempt < 5""",
    "retry_outcomes": f"WITH {_FAIL} SELECT stage, CASE WHEN attempt < 5 THEN 'republished' ELSE 'dlq' END AS result, count(*) AS events FROM fl GROUP BY 1, 2",
    "dlq_replay_cap": f"WITH {_LETTERS} SELECT seq, event_id, replay_no FROM ln",
    "dlq_shape_route": f"""WITH {_LETTERS} SELECT seq, shape, result, CASE WHEN result = 'success' THEN CASE shape WHEN 'page' THEN 'page.parsed' ELSE 'url.discovered' END END AS topic,
      result = 'success' AND shape = 'url' AS force_recrawl FROM lr""",
    "dlq_outcomes": f"WITH {_LETTERS} SELECT result, count(*) AS events FROM lr GROUP BY 1",
    "counter_by_label": "SELECT event_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, count(*) AS events FROM events GROUP BY 1, 2",
    "duration_buckets": "SELECT event_type, le, count(*) FILTER (le = '+Inf' OR value <= try_cast(nullif(le, '+Inf') AS DOUBLE)) AS events FROM events, (VALUES "
    + ", ".join(f"('{b}')" for b in _BOUNDS) + ", ('+Inf')) b(le) GROUP BY 1, 2",
    "rate_5m": _MIN.format(k=5) + f" SELECT event_type, {S.stamp('window_end')} AS window_end, count(*) AS events, round(count(*) / 300, 6) AS rate FROM sl GROUP BY event_type, sl.window_end",
    "p95_from_buckets": _quantile_sql(),
    "p95_exact": "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "alert_intervals": _MIN.format(k=5) + f" SELECT event_type, {S.stamp('breach_start')} AS breach_start, {S.stamp('fired_at')} AS fired_at, {S.stamp('breach_end')} AS breach_end, round(peak_rate, 6) AS peak_rate FROM ("
    + _alert_sql("true", 0.003, 2) + ")",
    "alert_rules": _MIN.format(k=5) + " " + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {S.stamp('breach_start')} AS breach_start, {S.stamp('fired_at')} AS fired_at, {S.stamp('breach_end')} AS breach_end FROM ("
        + _alert_sql(f"event_type = '{t}'", th, hold) + ")"
        for rule, t, th, hold in (("crawl_errors", "error", 0.1, 5), ("parser_errors", "view", 0.05, 5), ("dead_letters", "click", 0.0, 2))),
    "trace_ids": f"""WITH {S.EVENTS}, t AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN substr(sha256(event_id::VARCHAR), 1, 8) || '-xyz-' || substr(sha256(event_id::VARCHAR), 9, 8)
      ELSE substr(sha256(event_id::VARCHAR), 1, 8) || '-' || substr(sha256(event_id::VARCHAR), 9, k % 40) END AS id FROM ev),
      p AS (SELECT *, substr(rpad(replace(id, '-', ''), 32, '0'), 1, 32) AS pad FROM t),
      v AS (SELECT *, length(id) >= 16 AND regexp_matches(pad, '^[0-9a-fA-F]{{32}}$') AS ok FROM p)
      SELECT event_id, CASE WHEN ok THEN pad END AS trace, CASE WHEN ok THEN right(pad, 16) END AS span FROM v""",
    "trace_hops": f"WITH {_HOPS} SELECT event_id, trace, stage, hop, from_stage, latency_us, is_gap, is_backward FROM hops",
    "trace_timelines": f"""WITH {_HOPS} SELECT trace, count(*) AS hops, {S.stamp('min(ts)')} AS first_at, {S.stamp('max(ts)')} AS last_at, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us,
      max(latency_us) AS longest_us, count(*) FILTER (is_gap) AS gaps, count(*) FILTER (is_backward) AS backward,
      concat_ws(',', CASE WHEN NOT bool_or(stage = 'crawler') THEN 'crawler' END, CASE WHEN NOT bool_or(stage = 'parser') THEN 'parser' END,
        CASE WHEN NOT bool_or(stage = 'cleaner') THEN 'cleaner' END) AS missing FROM hops GROUP BY trace""",
}
