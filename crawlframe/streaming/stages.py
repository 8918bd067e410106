"""The crawl as streams that pass event topics along: crawl, parse, clean, retry, and the status of every URL.

A stage decodes its topic, drops repeated events, treats each micro-batch with the batch operators and writes the records of
each outgoing topic to a folder of its own batch; a repeated batch overwrites that folder. The crawl stage feeds its own topic
with the links it discovers, so draining the stages walks the link graph level by level.

What outlives a batch is in tables, not in stream state: the ledger of each stage, and tables in buckets (``Snapshot``), of which
a batch rewrites only those it touches: claims, URLs, artifacts, pages, URLs of jobs, counts of jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.functions.html import page_links, visible_markup
from crawlframe.functions.lang import unnest
from crawlframe.functions.urls import keep_allowed, normalize_url, url_key
from crawlframe.operators.accounting import status_counters
from crawlframe.operators.corpus import clean_pages, extract_pages, split_by_length
from crawlframe.operators.crawl import FAN_OUT, fetch_outcomes, queue_and_apply, robots_filter
from crawlframe.operators.dedup import HOUR, claim_batch
from crawlframe.operators.merge import upsert_artifacts, upsert_pages, upsert_urls, url_id
from crawlframe.operators.retry import reemit, route
from crawlframe.schemas import CLAIMS, CRAWL_JOB_URLS, CRAWL_JOBS, EVENTS, HTML_ARTIFACTS, JOB_COUNTS, JOB_URL_STATUSES, PAGES, TERMINAL_STATUSES, TRANSITIONS, URLS
from crawlframe.session import small_or_shuffled
from crawlframe.sources.events import RECORD, dead_letters, decode, encode
from crawlframe.sources.snapshots import Snapshot
from crawlframe.sources.tables import artifacts, read_artifacts, write_artifacts
from crawlframe.streaming.ledger import Ledger
from crawlframe.streaming.runtime import run_available

TOPICS = [*EVENTS, "dlq"]


@dataclass
class Work:
    """Folder of a crawl: topics, raw pages, status changes, tables, stream state."""

    spark: SparkSession
    folder: str
    buckets: int = 16
    tables: dict[str, Snapshot] = field(default_factory=dict)

    def __post_init__(self):
        for name, keys, schema in (
            ("claims", ["url_key"], CLAIMS), ("urls", ["normalized_url"], URLS), ("artifacts", ["url_id"], HTML_ARTIFACTS),
            ("pages", ["url_id"], PAGES), ("job_urls", ["job_id", "normalized_url"], CRAWL_JOB_URLS),
            ("job_counts", ["job_id"], JOB_COUNTS), ("jobs", ["id"], CRAWL_JOBS),
        ):
            self.tables[name] = Snapshot(f"{self.folder}/tables/{name}", keys, schema, self.buckets)
        for topic in TOPICS:  # a stage may run before anything was sent to it
            self._start(RECORD, self.topic(topic))
        self._start(TRANSITIONS, f"{self.folder}/status")

    def _start(self, schema: T.StructType, path: str) -> None:
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/start")

    def topic(self, name: str) -> str:
        return f"{self.folder}/topics/{name}"

    def publish(self, records: DataFrame, topic: str, stage: str, batch_id: int) -> None:
        """Records of a batch for another stage; in files of a fair size, because that stage's batches are bounded in files."""
        records.hint("rebalance").write.mode("overwrite").parquet(f"{self.topic(topic)}/{stage}-{batch_id}")

    def report(self, changes: DataFrame, stage: str, batch_id: int) -> None:
        """Status changes of a batch, for the status stage."""
        rows = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRANSITIONS.fields])
        rows.hint("rebalance").write.mode("overwrite").parquet(f"{self.folder}/status/{stage}-{batch_id}")

    def _stream(self, schema: T.StructType, path: str, max_files: int) -> DataFrame:
        return (self.spark.readStream.schema(schema).option("recursiveFileLookup", "true")
                .option("maxFilesPerTrigger", max_files).parquet(path))

    def records(self, topic: str, max_files: int = 64) -> DataFrame:
        return self._stream(RECORD, self.topic(topic), max_files)

    def changes(self, max_files: int = 64) -> DataFrame:
        return self._stream(TRANSITIONS, f"{self.folder}/status", max_files)


def once_key(topic: str) -> Column:
    """What passes a stage once: a URL of a job when it is first discovered (the job's seen set), else a try of an event."""
    again = F.concat_ws("|", "event_id", "attempt", "replay")
    if topic != "url.discovered":
        return again
    first = (F.col("attempt") == 1) & (F.col("replay") == 0)
    return F.when(first, F.concat_ws("|", F.lit("seen"), "job_id", url_key(F.col("normalized_url")))).otherwise(again)


def run_stage(work: Work, topic: str, stage: str, handle: Callable[[DataFrame, int], dict[str, DataFrame]]) -> int:
    """Run one stage over what its topic holds now; the number of events it took. The stream itself keeps no state: what has passed
    is in the stage's ledger. Undecodable records are left to ``quarantine``."""
    good, _ = decode(work.records(topic), topic)
    ledger, taken = Ledger(f"{work.folder}/ledger/{stage}", work.buckets), 0

    def each(batch: DataFrame, batch_id: int) -> None:
        nonlocal taken
        held = ledger.first_time(batch, once_key(topic), ["timestamp", "event_id"], batch_id)
        fresh = held.drop("_key", "_bucket")
        try:
            if n := held.count():
                for name, out in handle(fresh, batch_id).items():
                    work.publish(out, name, stage, batch_id)
                taken += n
        finally:
            held.unpersist()

    run_available(good, f"{work.folder}/checkpoints/{stage}", each)
    return taken


def quarantine(work: Work, topic: str) -> None:
    """Append the undecodable records of a topic to ``quarantine/<topic>``."""
    _, broken = decode(work.records(topic), topic)
    query = (broken.writeStream.format("parquet").option("path", f"{work.folder}/quarantine/{topic}")
             .option("checkpointLocation", f"{work.folder}/checkpoints/quarantine-{topic}").trigger(availableNow=True).start())
    query.awaitTermination()


def change(rows: DataFrame, status: str | Column, error: Column | None = None, checkpoint: Column | None = None) -> DataFrame:
    """Status changes of the URLs of some events."""
    none = F.lit(None)
    return rows.select(
        "job_id", "normalized_url", "depth", (F.lit(status) if isinstance(status, str) else status).alias("status"),
        (none if error is None else error).cast("string").alias("error"),
        (none if checkpoint is None else checkpoint).cast("map<string,string>").alias("checkpoint"), "timestamp")


def _failures(failed: DataFrame) -> dict[str, DataFrame]:
    """Failed events (with error and stage): to the retry topic, or out of attempts to the dead letters."""
    again, dead = route(failed)
    body = F.to_json(F.struct(*[c for c in failed.columns if c not in ("error", "stage", "page_payload")]))
    return {
        "url.failed": encode(again.drop("should_retry", "delay_seconds", "reason"), "url.failed"),
        "dlq": dead_letters(dead.select("error", body.alias("payload"))),
    }


def seed(work: Work, jobs: DataFrame, seeds: DataFrame, name: str = "seed") -> None:
    """Register jobs (CRAWL_JOBS) and queue seeds (job_id, url, normalized_url, max_depth, allowed_domains, timestamp)."""
    work.tables["jobs"].merge(jobs, lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new), name, 0)
    events = seeds.withColumns({
        "event_id": F.sha2(F.concat_ws("|", F.lit("seed"), "job_id", "normalized_url"), 256), "trace_id": F.lit(""), "depth": F.lit(0),
        "attempt": F.lit(1), "force_recrawl": F.lit(False), "replay": F.lit(0), "schema_version": F.lit(1)})
    work.report(change(events, "queued"), name, 0)
    work.publish(encode(events, "url.discovered"), "url.discovered", name, 0)


def discovered(fetched: DataFrame) -> DataFrame:
    """Events of the links of fetched pages, one level deeper: inside the job's domains, the first 50 of a page."""
    links = F.slice(keep_allowed(page_links(visible_markup(F.col("html")), F.col("url")), F.col("allowed_domains")), 1, FAN_OUT)
    keep = ["job_id", "trace_id", "max_depth", "allowed_domains", "timestamp", (F.col("depth") + 1).alias("depth"), F.col("event_id").alias("_from")]
    rows = fetched.where(F.col("depth") < F.col("max_depth")).transform(unnest, links, "url", keep=keep)
    return rows.withColumn("normalized_url", normalize_url("url")).dropDuplicates(["job_id", "normalized_url"]).withColumns({
        "event_id": F.sha2(F.concat_ws("|", "_from", "normalized_url"), 256), "attempt": F.lit(1), "force_recrawl": F.lit(False),
        "replay": F.lit(0), "schema_version": F.lit(1)}).drop("_from")


def crawl_stage(work: Work, corpus: DataFrame | Callable[[DataFrame], DataFrame], robots: DataFrame | None = None, agent: str = "crawlframe", ttl_seconds: int = HOUR) -> int:
    """Discovered URLs meet the corpus (normalized_url, html, http_status) in place of the network; it is a frame or a function that
    gives the rows of the wanted URLs (``_url``).

    Claim, robots rules, status, comparison with the stored hash, in this order; what passes is stored and its links are sent
    to this stage's own topic. Retries and replays take no claim, forced events release it.
    """
    claims, urls = work.tables["claims"], work.tables["urls"]

    def handle(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        events = batch.withColumn("url_key", url_key(F.col("normalized_url")))
        free = (F.col("attempt") > 1) | (F.col("replay") > 0)
        first = events.where(~free)
        held = claim_batch(first, claims.known(first), "url_key", "timestamp", "event_id", ttl_seconds, "force_recrawl").persist()
        passed = held.select(F.explode("passed").alias("event_id")).distinct().withColumn("is_claimed", F.lit(False))
        log = events.join(passed, "event_id", "left").withColumns({
            "is_duplicate": F.lit(False), "is_claimed": F.coalesce("is_claimed", ~free)})
        log = log.withColumn("allowed", F.lit(True)) if robots is None else robots_filter(log, robots, agent)
        # the few events of a batch are sent to the corpus, not the corpus to them
        wanted = small_or_shuffled(log.where("NOT is_claimed AND allowed").select(F.col("normalized_url").alias("_url")).distinct())
        found = corpus(wanted) if callable(corpus) else corpus.join(wanted, F.col("normalized_url") == F.col("_url"), "left_semi")
        pages = found.select("normalized_url", "html", "http_status")
        stored = urls.known(log).select("normalized_url", F.col("content_hash").alias("stored_hash"))
        met = log.join(pages, "normalized_url", "left").join(stored, "normalized_url", "left")
        met = artifacts(met, F.col("job_id")).withColumn("stored_hash", F.coalesce("stored_hash", F.lit("")))
        lost = (F.col("outcome") == "fetched") & F.col("html").isNull()
        met = fetch_outcomes(met).withColumns({
            "error": F.when(lost, "no response").otherwise(F.col("error")), "checkpoint": F.when(~lost, F.col("checkpoint")),
            "outcome": F.when(lost, "failed").otherwise(F.col("outcome"))}).persist()
        try:
            met.count()
            fetched = met.where("outcome = 'fetched'")
            write_artifacts(fetched.select("storage_key", "checksum", "html"), f"{work.folder}/raw/batch={batch_id}", mode="overwrite")
            links = discovered(fetched).persist()
            claimed = change(events, "claimed", checkpoint=F.create_map(F.lit("stage"), F.lit("crawler")))
            reached = change(met, F.col("outcome"), F.col("error"), F.col("checkpoint"))
            work.report(claimed.unionByName(reached).unionByName(change(links, "queued")), "crawler", batch_id)
            claims.merge(held.drop("passed"), lambda old, new: old.join(new.select("url_key"), "url_key", "left_anti").unionByName(new), "crawler", batch_id)
            same = met.where((F.col("outcome") == "skipped") & (F.col("checkpoint")["reason"] == "unchanged"))
            seen = same.groupBy("normalized_url").agg(F.max("timestamp").alias("_at"))
            urls.merge(seen, lambda old, new: old.join(new, "normalized_url", "left").withColumn(
                "last_crawled_at", F.greatest("last_crawled_at", "_at")), "crawler", batch_id)
            failed = met.where("outcome = 'failed'").withColumn("stage", F.lit("crawler")).select(
                *batch.columns, "error", "stage")
            for name, out in ({"html.fetched": encode(fetched, "html.fetched"), "url.discovered": encode(links, "url.discovered")} | _failures(failed)).items():
                work.publish(out, name, "crawler", batch_id)
            links.unpersist()
        finally:
            met.unpersist()
            held.unpersist()
        return {}

    return run_stage(work, "url.discovered", "crawler", handle)


def parse_stage(work: Work) -> int:
    """Fetched events meet the stored pages and become page records."""
    def handle(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        keyed = batch.select("storage_key", "checksum").distinct()
        raw = read_artifacts(work.spark, f"{work.folder}/raw", keyed, ["storage_key", "checksum"]).select("storage_key", "checksum", "html")
        met = batch.join(raw.dropDuplicates(["storage_key", "checksum"]), ["storage_key", "checksum"], "left")
        missing = met.where(F.col("html").isNull()).drop("html").withColumns({"error": F.lit("stored page missing"), "stage": F.lit("parser")})
        work.report(change(missing, "failed", F.col("error")), "parser", batch_id)
        pages = extract_pages(met.where(F.col("html").isNotNull()).drop("content_type"))
        return {"page.parsed": encode(pages, "page.parsed"), **_failures(missing)}

    return run_stage(work, "html.fetched", "parser", handle)


def clean_stage(work: Work) -> int:
    """Parsed pages are cleaned and merged into the URL, artifact and page tables; rows too long for a column fail with their payload."""
    order = ["timestamp", "event_id"]

    def handle(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        rows = clean_pages(batch).withColumns({"url_id": url_id(F.col("normalized_url")), "domain": F.lit("")})
        fine, wrong = split_by_length(rows.drop("domain"))
        work.tables["urls"].merge(fine, lambda old, new: upsert_urls(old, new, order), "cleaner", batch_id)
        stored = fine.select("url_id", F.col("url_id").alias("id"), "storage_key", "checksum", "size_bytes", F.lit(200).alias("http_status"),
                             F.col("timestamp").alias("fetched_at"), *order[:1], "event_id")
        work.tables["artifacts"].merge(stored, lambda old, new: upsert_artifacts(old, new, order), "cleaner", batch_id)
        content = fine.withColumns({"id": F.col("url_id"), "created_at": F.col("timestamp")})
        work.tables["pages"].merge(content, lambda old, new: upsert_pages(old, new, order), "cleaner", batch_id)
        failed = wrong.drop("url_id").withColumns({"stage": F.lit("cleaner"), "page_payload": F.to_json(F.struct(*batch.columns))})
        work.report(change(fine, "parsed").unionByName(change(failed, "failed", F.col("error"))), "cleaner", batch_id)
        return _failures(failed)

    return run_stage(work, "page.parsed", "cleaner", handle)


def retry_stage(work: Work) -> int:
    """Failed events are sent again as the next attempt, to the stage that their payload fits, at their retry time in event time."""
    def handle(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        again, dead = route(batch)
        sent = reemit(again).withColumn("timestamp", F.col("retry_at"))
        page = sent.where("topic = 'page.parsed'").select(
            F.from_json("page_payload", EVENTS["page.parsed"]).alias("p"), F.col("attempt").alias("_n"), F.col("timestamp").alias("_t")).select("p.*", "_n", "_t")
        page = page.withColumns({"attempt": F.col("_n"), "timestamp": F.col("_t")}).drop("_n", "_t")
        out = {"url.discovered": encode(sent.where("topic = 'url.discovered'"), "url.discovered"), "page.parsed": encode(page, "page.parsed")}
        return out | {"dlq": _failures(dead.select(*batch.columns))["dlq"]}

    return run_stage(work, "url.failed", "retry", handle)


def status_stage(work: Work) -> int:
    """Status changes are merged into the job URLs; each moves one URL between the counts of its job, and a job whose
    URLs are all finished is completed in the same batch."""
    job_urls, counts, jobs = work.tables["job_urls"], work.tables["job_counts"], work.tables["jobs"]
    taken = 0

    def each(batch: DataFrame, batch_id: int) -> None:
        nonlocal taken
        batch = batch.persist()
        try:
            if not (n := batch.count()):
                return
            taken += n
            moved = f"{work.folder}/moves/{batch_id}"
            if not job_urls.done(work.spark, "status", batch_id):  # the moves need the rows as they were
                old = job_urls.known(batch)
                new = queue_and_apply(old, batch, "timestamp")
                status_counters(old, new).write.mode("overwrite").parquet(moved)
                job_urls.merge(batch, lambda o, d: queue_and_apply(o, d, "timestamp"), "status", batch_id)
            moves = work.spark.read.parquet(moved)
            total = lambda old, new: old.unionByName(new).groupBy("job_id").agg(*[F.sum(s).alias(s) for s in JOB_URL_STATUSES])
            counts.merge(moves, total, "status", batch_id)
            now = counts.known(moves).join(moves.select("job_id"), "job_id", "left_semi")
            everything = sum((F.col(s) for s in JOB_URL_STATUSES), F.lit(0))
            finished = sum((F.col(s) for s in TERMINAL_STATUSES), F.lit(0))
            verdict = now.select(F.col("job_id").alias("id"), everything.alias("_all"), (everything == finished).alias("_done"))
            jobs.merge(verdict, lambda old, new: old.join(new, "id", "left").withColumns({
                "status": F.when(F.col("_done"), "completed").when(F.col("_done") == F.lit(False), "running").otherwise(F.col("status")),
                "urls_queued": F.coalesce(F.col("_all").cast("int"), F.col("urls_queued"))}), "status", batch_id)
        finally:
            batch.unpersist()

    run_available(work.changes(), f"{work.folder}/checkpoints/status", each)
    return taken


def drain(work: Work, corpus: DataFrame | Callable[[DataFrame], DataFrame], robots: DataFrame | None = None, agent: str = "crawlframe", retries: bool = True,
          ttl_seconds: int = HOUR) -> None:
    """Run the stages until none has anything left; every round of the crawl stage reaches one link further."""
    while True:
        while crawl_stage(work, corpus, robots, agent, ttl_seconds):
            pass
        parse_stage(work)
        clean_stage(work)
        again = retry_stage(work) if retries else 0
        status_stage(work)
        if not again:
            return
