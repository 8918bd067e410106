"""Streams over several micro-batches against the batch operators."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from crawlframe.operators import crawl, dedup, merge, retry
from crawlframe.plans import bindings as B
from crawlframe.schemas import CRAWL_JOBS
from crawlframe.session import run_folder
from crawlframe.sources import snapshots
from crawlframe.sources.snapshots import Snapshot
from crawlframe.streaming import keyed, stages
from crawlframe.streaming.ledger import Ledger
from crawlframe.streaming.runtime import BatchLog, collect_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, seq long, forced boolean"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def log(spark):
    rnd = random.Random(11)
    data = [(f"k{rnd.randrange(4)}", T0 + dt.timedelta(seconds=rnd.randrange(0, 400_000)), i, rnd.random() < 0.05) for i in range(240)]
    return spark.createDataFrame(sorted(data, key=lambda r: r[1]), SCHEMA)


def in_three_files(spark, df, folder):
    """The rows as three files in time order, one per micro-batch."""
    edges = [0, 130_000, 270_000, 400_001]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        part = df.filter((F.unix_seconds("ts") >= int(T0.replace(tzinfo=dt.UTC).timestamp()) + a) & (F.unix_seconds("ts") < int(T0.replace(tzinfo=dt.UTC).timestamp()) + b))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
        time.sleep(1.1)
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def test_keyed_state_over_batches(spark, tmp_path):
    df = log(spark)
    stream = in_three_files(spark, df, str(tmp_path / "in"))
    claims = collect_stream(keyed.claims_stream(stream, "key", "ts", 3600, F.col("forced")), run_folder(spark, "t1")).read(spark)
    assert claims.select("batch").distinct().count() == 3
    assert rows(claims.drop("batch")) == rows(dedup.ttl_claims(df, "key", "ts", 3600, force="forced"))

    letters = stream.select(F.col("key").alias("event_id"), "seq", "ts")
    replays = collect_stream(keyed.replay_stream(letters, "ts", 7200), run_folder(spark, "t2")).read(spark).select("seq", "replay_no")
    assert rows(replays) == rows(retry.replay_numbers(df, "key", "ts", ["seq"], ttl_seconds=7200).select("seq", "replay_no"))

    waits = collect_stream(keyed.politeness_stream(stream, "key", "ts", "seq", rate=1 / 4000, burst=3), run_folder(spark, "t3")).read(spark)
    want = crawl.politeness(df, "key", "ts", ["seq"], rate=1 / 4000, burst=3)
    assert rows(waits.select("seq", "wait_us")) == rows(want.select("seq", F.round(F.col("wait_seconds") * 1_000_000).cast("bigint")))


def test_delayed_retries(spark, tmp_path):
    now = time.time()
    due = [("u1", now - 5), ("u1", now + 6), ("u2", now + 6)]
    df = spark.createDataFrame(due, "url string, due double").withColumn("retry_at", F.timestamp_micros((F.col("due") * 1_000_000).cast("long"))).drop("due")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = BatchLog(str(tmp_path / "out"))
    sent = []

    def each(batch, batch_id):
        sent.extend((r["due_ms"] / 1000, time.time()) for r in batch.collect())
        out.write(batch, batch_id)

    query = (keyed.delayed_retries(stream, "url", "retry_at").writeStream.foreachBatch(each)
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="1 second").start())
    try:
        end = time.time() + 60
        while len(sent) < 3 and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert len(sent) == 3 and all(seen >= due for due, seen in sent)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def seeds_of(spark, urls, job="j", depth=0):
    return spark.createDataFrame([(job, u, u, depth, ["h"], T0) for u in urls],
                                 "job_id string, url string, normalized_url string, max_depth int, allowed_domains array<string>, timestamp timestamp")


def job(spark, *ids):
    return spark.createDataFrame([(i, [], 1, None, "running", 0, None, None) for i in ids], CRAWL_JOBS)


def topic(spark, work, name, *fields):
    df = spark.read.option("recursiveFileLookup", "true").parquet(work.topic(name))
    return rows(df.select(*[F.get_json_object("value", f"$.{f}") for f in fields]))


def test_failures_retries_and_dead_letters(spark, few_partitions):
    """A missing page and an HTTP error are tried five times and then given up; a second seed of a URL is not seen again."""
    work = stages.Work(spark, run_folder(spark, "t4"), buckets=4)
    corpus = spark.createDataFrame([("http://h/ok", "<p>x</p>", 200), ("http://h/bad", "", 503)], "normalized_url string, html string, http_status int")
    stages.seed(work, job(spark, "j"), seeds_of(spark, ["http://h/ok", "http://h/gone", "http://h/bad"]))
    stages.seed(work, job(spark, "j"), seeds_of(spark, ["http://h/ok"]), "seed-again")
    stages.drain(work, corpus)
    assert len(topic(spark, work, "html.fetched", "event_id")) == 1
    failed = topic(spark, work, "url.failed", "normalized_url", "error", "stage", "attempt")
    assert failed == sorted((u, e, "crawler", str(n)) for u, e in (("http://h/gone", "no response"), ("http://h/bad", "HTTP 503")) for n in range(1, 5))
    assert topic(spark, work, "dlq", "error", "payload.normalized_url", "payload.attempt") == [("HTTP 503", "http://h/bad", "5"), ("no response", "http://h/gone", "5")]
    state = {r["normalized_url"]: (r["status"], r["error"]) for r in work.tables["job_urls"].read(spark).collect()}
    assert state == {"http://h/ok": ("parsed", None), "http://h/gone": ("failed", "no response"), "http://h/bad": ("failed", "HTTP 503")}
    counts = work.tables["job_counts"].read(spark).first().asDict()
    assert counts == {"job_id": "j", "queued": 0, "claimed": 0, "fetched": 0, "parsed": 1, "skipped": 0, "failed": 2}
    done = work.tables["jobs"].read(spark).first()
    assert (done["status"], done["urls_queued"]) == ("completed", 3)
    assert work.tables["pages"].read(spark).select("text_snippet").collect()[0][0] == "x"


def test_links_are_followed_robots_kept_and_unchanged_pages_skipped(spark, few_partitions):
    """Two jobs over one site: levels equal the batch frontier; within the hour a second job meets claims, a day later equal pages."""
    page = lambda *to: "<title>T</title>" + "".join(f"<a href='/{t}'>x</a>" for t in to)
    site = {"a": page("b", "c"), "b": page("d", "a", "private/x"), "c": page("d", "e"), "d": page("f"), "e": page(), "f": page("a"), "private/x": page("f")}
    corpus = spark.createDataFrame([(f"http://h/{k}", v, 200) for k, v in site.items()], "normalized_url string, html string, http_status int")
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /private\n")], "site string, robots_txt string")
    work = stages.Work(spark, run_folder(spark, "t5"), buckets=4)
    stages.seed(work, job(spark, "j"), seeds_of(spark, ["http://h/a"], depth=2))
    stages.drain(work, corpus, robots, retries=False)
    state = rows(work.tables["job_urls"].read(spark).select("normalized_url", "depth", "status", "error"))
    want = [("http://h/a", 0), ("http://h/b", 1), ("http://h/c", 1), ("http://h/d", 2), ("http://h/e", 2)]
    assert state == [(u, n, "parsed", None) for u, n in want] + [("http://h/private/x", 2, "skipped", "robots_disallowed")]
    edges = spark.createDataFrame([(f"http://h/{k}", f"http://h/{t}") for k, v in site.items() for t in site if f"'/{t}'" in v], "src string, dst string")
    first = spark.createDataFrame([("j", "http://h/a")], "job_id string, normalized_url string")
    assert rows(crawl.expand_frontier(first, edges, 2).select("normalized_url", "depth")) == [(u, n) for u, n, *_ in state]

    later = T0 + dt.timedelta(days=1)
    stages.seed(work, job(spark, "k"), seeds_of(spark, ["http://h/a", "http://h/f"], "k", 1).withColumn(
        "timestamp", F.when(F.col("url") == "http://h/a", F.lit(T0 + dt.timedelta(minutes=5))).otherwise(F.lit(later))), "second")
    stages.drain(work, corpus, robots, retries=False)
    again = {r["normalized_url"]: (r["status"], (r["checkpoint"] or {}).get("reason")) for r in work.tables["job_urls"].read(spark).where("job_id = 'k'").collect()}
    # a: the claim of the first job holds; f: new, and its link to a was seen by the job already
    assert again == {"http://h/a": ("skipped", None), "http://h/f": ("parsed", None)}
    stages.seed(work, job(spark, "m"), seeds_of(spark, ["http://h/b"], "m").withColumn("timestamp", F.lit(later)), "third")
    stages.drain(work, corpus, robots, retries=False)
    assert rows(work.tables["job_urls"].read(spark).where("job_id = 'm'").select("status", F.col("checkpoint")["reason"])) == [("skipped", "unchanged")]
    seen = {r["normalized_url"]: r["last_crawled_at"] for r in work.tables["urls"].read(spark).collect()}
    assert seen["http://h/b"] == later and seen["http://h/c"] == T0
    assert {r["id"]: r["status"] for r in work.tables["jobs"].read(spark).collect()} == {"j": "completed", "k": "completed", "m": "completed"}


def test_too_long_rows_fail_in_the_cleaner_with_their_payload(spark, few_partitions):
    work = stages.Work(spark, run_folder(spark, "t6"), buckets=2)
    long = "http://h/" + "x" * 2050
    corpus = spark.createDataFrame([(long, "<title>T</title>", 200), ("http://h/a", "<title>A</title>", 200)], "normalized_url string, html string, http_status int")
    stages.seed(work, job(spark, "j"), seeds_of(spark, [long, "http://h/a"]))
    stages.drain(work, corpus)
    assert [r["title"] for r in work.tables["pages"].read(spark).collect()] == ["A"]
    failed = topic(spark, work, "url.failed", "stage", "attempt", "error")
    assert failed == [("cleaner", str(n), "normalized_url too long") for n in range(1, 5)]
    assert topic(spark, work, "dlq", "error", "payload.attempt", "payload.title") == [("normalized_url too long", "5", "T")]


def test_snapshot_rewrites_only_touched_buckets(spark, tmp_path):
    schema = "k long, first string, last string"
    table = Snapshot(str(tmp_path / "t"), ["k"], spark.createDataFrame([], schema).schema, 8)
    how = lambda old, new: merge.upsert(old, new, "k", ["n"], ["first"], ["last"])
    delta = lambda *data: spark.createDataFrame([(k, v, v, n) for n, (k, v) in enumerate(data)], schema + ", n int")
    files = lambda: {f"{p}/{f}" for p in table.state(spark)[1].values() for f in snapshots.folders(spark, p) if f.startswith("part")}
    assert table.read(spark).count() == 0 and table.merge(delta(*[(k, f"a{k}") for k in range(40)]), how, "w", 0)
    before = files()
    assert table.merge(delta((3, "b"), (3, "c"), (99, "d")), how, "w", 1)
    touched = len(table.touched(delta((3, ""), (99, ""))))
    assert len(before & files()) == len(before) - touched
    want = {k: (f"a{k}", f"a{k}") for k in range(40)} | {3: ("a3", "c"), 99: ("d", "d")}
    assert {r["k"]: (r["first"], r["last"]) for r in table.read(spark).collect()} == want
    assert not table.merge(delta((3, "again")), how, "w", 1) and table.merge(delta((5, "x")), how, "other", 0)
    assert {r["k"]: r["last"] for r in table.read(spark).collect()} == {k: v[1] for k, v in want.items()} | {5: "x"}
    assert len(snapshots.folders(spark, f"{table.folder}/manifests")) == 2


def test_claims_of_batches_equal_one_log(spark):
    """Cut anywhere, the claims of a log are those of the whole log."""
    rnd = random.Random(2)
    data = sorted((T0 + dt.timedelta(seconds=rnd.randrange(0, 40_000)), f"k{rnd.randrange(3)}", rnd.random() < 0.1) for _ in range(150))
    log = [(k, t, f"e{i:03}", f) for i, (t, k, f) in enumerate(data)]
    schema = "key string, ts timestamp, e string, forced boolean"
    want = dedup.ttl_claims(spark.createDataFrame(log, schema), "key", "ts", 3600, "forced")
    held, got = spark.createDataFrame([], "key string, claimed_at timestamp"), []
    for part in (log[:40], log[40:41], log[41:]):
        out = dedup.claim_batch(spark.createDataFrame(part, schema), held, "key", "ts", "e", 3600, "forced")
        now = [tuple(r) for r in out.collect()]
        got += [e for _, passed, _ in now for e in passed]
        kept = {r["key"]: r["claimed_at"] for r in held.collect()} | {k: t for k, _, t in now}
        held = spark.createDataFrame(list(kept.items()), "key string, claimed_at timestamp")
    of = {e: (k, t, f) for k, t, e, f in log}
    assert sorted({of[e] for e in got}) == sorted(tuple(r) for r in want.collect())
    assert len(got) == len(set(got))


def test_ledger_keeps_what_passed_over_batches_and_repeats(spark, tmp_path):
    """Later batches drop what has passed, a repeated batch decides as before, tries and replays of an event are different keys."""
    log = Ledger(str(tmp_path / "l"), 4)
    key = F.concat_ws("|", "e", "attempt", "replay")
    batch = lambda *data: spark.createDataFrame(data, "e string, attempt int, replay int, n int")
    got = lambda df: sorted((r["e"], r["attempt"], r["replay"], r["n"]) for r in df.collect())
    assert got(log.first_time(batch(("a", 1, 0, 2), ("a", 1, 0, 1), ("b", 1, 0, 3)), key, ["n"], 0)) == [("a", 1, 0, 1), ("b", 1, 0, 3)]
    second = [("a", 1, 0, 4), ("a", 2, 0, 5), ("a", 1, 1, 6), ("c", 1, 0, 7)]
    want = [("a", 1, 1, 6), ("a", 2, 0, 5), ("c", 1, 0, 7)]
    assert got(log.first_time(batch(*second), key, ["n"], 1)) == want
    assert got(log.first_time(batch(*second), key, ["n"], 1)) == want
    assert got(log.first_time(batch(*second), key, ["n"], 2)) == []
    assert got(log.first_time(batch(), key, ["n"], 3)) == []
    assert got(log.first_time(batch(("d", 1, 0, 1)), key, ["n"], 4)) == [("d", 1, 0, 1)]


def test_a_crawl_reads_only_wanted_pages(spark):
    """The HTML of the corpus is not shuffled to find the pages of a batch: only ids meet the wanted URLs."""
    pages = spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(100)], "page_id long, html string")
    chosen = spark.createDataFrame([(i, f"http://a/{i}") for i in range(0, 100, 2)], "page_id long, normalized_url string")
    wanted = spark.createDataFrame([("http://a/4",), ("http://a/5",), ("http://a/98",)], "_url string")
    found = B.html_on_demand(chosen, pages)(wanted)
    assert {tuple(r) for r in found.collect()} == {("http://a/4", "<p>4</p>"), ("http://a/98", "<p>98</p>")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "html" in line]
    assert "BroadcastHashJoin [page_id" in plan
