"""Operators on small fixtures against step-by-step models."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlframe.operators import accounting, corpus, crawl, dedup, merge, metrics, ordered, retry, search
from crawlframe.sources import events as E
from crawlframe.sources.tables import artifacts, read_artifacts, read_html_files, write_artifacts

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def claim_model(log, ttl):
    out, last = set(), {}
    for key, t, forced in sorted(log, key=lambda x: (x[0], x[1], not x[2])):
        if forced:
            last.pop(key, None)
            out.add((key, at(t), True))
        elif key not in last or t >= last[key] + ttl:
            last[key] = t
            out.add((key, at(t), False))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
@pytest.mark.parametrize("with_force", [False, True])
def test_claims(spark, hot_rows, with_force):
    rnd = random.Random(7)
    log = [("hot", rnd.randrange(0, 40_000), with_force and rnd.random() < 0.02) for _ in range(800)]
    log += [("gap", s, False) for s in (0, 3599, 3600, 3601, 7199, 7200, 100_000)]
    log += [(f"k{rnd.randrange(20)}", rnd.randrange(0, 90_000), with_force and rnd.random() < 0.2) for _ in range(60)]
    df = spark.createDataFrame([(k, at(t), f) for k, t, f in log], "k string, ts timestamp, f boolean")
    got = dedup.ttl_claims(df, "k", "ts", 3600, force="f" if with_force else None, hot_rows=hot_rows)
    assert rows(got) == claim_model(log, 3600)


def test_claims_at_one_instant(spark):
    df = spark.createDataFrame([(3, "a", at(0)), (2, "a", at(0)), (4, "a", at(90_000)), (5, "b", at(0))], "event_id long, k string, ts timestamp")
    assert rows(dedup.claim_winners(df, "k", "ts", "event_id")) == [(2,), (4,), (5,)]


@pytest.fixture
def partitions(spark):
    """Sets the number of shuffle partitions for one test."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_key_at_one_instant_spreads(spark, partitions):
    """Chunks by position are even, in order, and give one running count."""
    partitions("8")
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.lit(at(0)).alias("ts"), "id")
    chunks = ordered.by_position(df, ["k"], ["ts", "id"])
    sizes = chunks.groupBy(ordered.CHUNK).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy(ordered.CHUNK).collect()
    assert len(sizes) == 8 and max(r["n"] for r in sizes) < 2 * 20_000 / 8
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
    got = ordered.count_before(chunks, ["k"], ["ts", "id"], F.lit(1), "n")
    assert got.where("n <> id").count() == 0
    replayed = retry.replay_numbers(df, "k", "ts", ["id"])
    assert replayed.where("replay_no <> id + 1").count() == 0
    waits = crawl.politeness(df, "k", "ts", ["id"], rate=1.0, burst=5)
    assert waits.where(F.abs(F.col("wait_seconds") - F.greatest(F.col("id") - 4, F.lit(0))) > 1e-6).count() == 0


def test_exact_quantile_with_an_outlier(spark, partitions):
    """One far value does not put the others into one chunk."""
    partitions("6")
    values = [*[i / 7 for i in range(3_000)], 1e12]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0), ("b", None)], "k string, v double")
    got = {r["k"]: r["quantile"] for r in metrics.exact_quantile(df, "v", ["k"]).collect()}
    assert abs(got["a"] - float(np.quantile(values, 0.95))) < 1e-9 and got["b"] == 5.0


def test_politeness_like_a_bucket(spark, partitions):
    rnd = random.Random(3)
    log = [(f"d{rnd.randrange(3)}", round(rnd.random() * 60, 3), i) for i in range(150)] + [("idle", t, 900 + i) for i, t in enumerate([0, 0, 0, 0, 0, 0, 0, 500, 500])]
    want = {}
    for domain in {d for d, _, _ in log}:
        tokens, last, clock = 5.0, None, 0.0
        for t, i in sorted((t, i) for d, t, i in log if d == domain):
            now = max(t, clock)
            last = now if last is None else last
            tokens = min(5.0, tokens + (now - last))
            if tokens < 1 - 1e-9:
                now, tokens = now + (1 - tokens), 1.0
            tokens, last, clock = tokens - 1, now, now
            want[i] = now - t
    df = spark.createDataFrame([(d, at(t), i) for d, t, i in log], "d string, ts timestamp, i long")
    for parts in ("3", "17"):
        partitions(parts)
        got = {r["i"]: r["wait_seconds"] for r in crawl.politeness(df, "d", "ts", ["i"]).collect()}
        assert got.keys() == want.keys()
        assert max(abs(got[i] - want[i]) for i in want) < 1e-5


def test_round_robin(spark):
    df = spark.createDataFrame([("a", at(i), i, i == 1) for i in range(5)], "lane string, ts timestamp, i long, bad boolean")
    got = crawl.assign_round_robin(df, ["x", "y", "z"], ["lane"], ["i"], "ts", F.col("bad"))
    assert [r["proxy"] for r in got.orderBy("i").collect()] == ["x", "y", "x", "y", "z"]
    assert crawl.assign_round_robin(df, [], ["lane"], ["i"], "ts").filter("proxy is not null").count() == 0


@pytest.mark.parametrize("parts", ["2", "13"])
def test_replay_numbers(spark, partitions, parts):
    partitions(parts)
    rnd = random.Random(5)
    log = [(f"e{rnd.randrange(4)}", rnd.randrange(0, 900_000), i) for i in range(90)] + [("edge", 0, 200), ("edge", 86_399, 201), ("edge", 172_799, 202)]
    want, state = {}, {}
    for k, t, i in sorted(log, key=lambda x: (x[0], x[1], x[2])):
        n, last = state.get(k, (0, None))
        n = 1 if last is None or t - last >= 86_400 else n + 1
        state[k] = (n, t)
        want[i] = n
    df = spark.createDataFrame([(k, at(t), i) for k, t, i in log], "k string, ts timestamp, i long")
    got = {r["i"]: r["replay_no"] for r in retry.replay_numbers(df, "k", "ts", ["i"]).collect()}
    assert got == want


def test_dead_letter_replay(spark):
    page = {"event_id": "p", "job_id": "j", "url": "u", "normalized_url": "u", "storage_key": "s", "checksum": "c", "extracted_links": []}
    url = {"event_id": "u", "job_id": "j", "url": "u", "normalized_url": "u"}
    letters = [json.dumps(page), json.dumps(url), '{"event_id":"x"}', "[1]", json.dumps({**url, "event_id": "n", "job_id": None})]
    letters += [json.dumps({**url, "event_id": "cap"})] * 5
    df = spark.createDataFrame([("e", p, at(i), i) for i, p in enumerate(letters)], "error string, payload string, ts timestamp, seq long")
    got = retry.replay(df, "ts", ["seq"]).orderBy("seq").collect()
    assert [(r["result"], r["topic"], r["force_recrawl"]) for r in got] == [
        ("success", "page.parsed", False), ("success", "url.discovered", True), ("unrecognized", None, False), ("unrecognized", None, False),
        ("error", None, False), *[("success", "url.discovered", True)] * 3, *[("cap_exceeded", None, False)] * 2,
    ]


def test_retry_decisions(spark):
    df = spark.createDataFrame([(n, "boom") for n in (1, 2, 3, 4, 5)], "attempt int, error string")
    got = [tuple(r)[2:] for r in retry.decide(df, base_delay=2.0).orderBy("attempt").collect()]
    assert got == [(True, 2.0, "boom"), (True, 4.0, "boom"), (True, 8.0, "boom"), (True, 16.0, "boom"), (False, 0.0, "max attempts reached: boom")]
    again, dead = retry.route(df)
    assert (again.count(), dead.count()) == (4, 1)


def test_events_round_trip(spark):
    body = json.dumps({"event_id": "e1", "job_id": "j", "url": "http://h/A", "normalized_url": "http://h/a", "depth": 2, "attempt": 3, "timestamp": "2024-01-01T00:00:00Z"})
    values = [body, '{"job_id":"j","url":"x"}', "{cut", None]
    df = spark.createDataFrame([("url.discovered", "k", v, [("trace_id", bytearray(b"t1"))]) for v in values], E.RECORD)
    good, bad = E.decode(df, "url.discovered")
    row = good.first()
    assert (row["trace_id"], row["depth"], row["attempt"], row["max_depth"], row["allowed_domains"], row["force_recrawl"]) == ("t1", 2, 3, 1, [], False)
    assert sorted(r["problem"] for r in bad.collect()) == ["missing normalized_url", "unreadable", "unreadable"]
    again, none = E.decode(E.encode(good, "url.discovered"), "url.discovered")
    assert none.count() == 0 and rows(again) == rows(good)
    letter = E.dead_letters(spark.createDataFrame([('say "no"', body)], "error string, payload string")).first()
    assert json.loads(letter["value"]) == {"error": 'say "no"', "payload": json.loads(body)}


def test_upserts_and_replay(spark):
    base = spark.createDataFrame(
        [("1", "j0", "http://old", "u1", "h", "failed", "x", 5, at(0), at(0)), ("2", "j0", "http://keep", "u2", "h", "parsed", "y", 1, at(0), at(0))],
        "id string, job_id string, canonical_url string, normalized_url string, domain string, status string, content_hash string, depth int, last_crawled_at timestamp, created_at timestamp")
    parsed = spark.createDataFrame(
        [("u1", "j1", "http://new", "c1", 0, at(10)), ("http://h3/", "j1", "http://first", "c2", 1, at(10)), ("http://h3/", "j2", "http://second", "c3", 2, at(20))],
        "normalized_url string, job_id string, url string, checksum string, depth int, timestamp timestamp")
    once = merge.upsert_urls(base, parsed, ["timestamp"])
    got = {r["normalized_url"]: r for r in once.collect()}
    assert len(got) == 3
    assert (got["u1"]["job_id"], got["u1"]["canonical_url"], got["u1"]["status"], got["u1"]["content_hash"], got["u1"]["depth"]) == ("j0", "http://old", "parsed", "c1", 5)
    assert got["u2"]["content_hash"] == "y"
    new = got["http://h3/"]
    assert (new["job_id"], new["canonical_url"], new["content_hash"], new["depth"], new["created_at"], new["last_crawled_at"]) == ("j1", "http://first", "c3", 1, at(10), at(20))
    assert rows(merge.upsert_urls(once, parsed, ["timestamp"])) == rows(once)
    assert rows(merge.hash_snapshot(once)) == [("http://h3/", "c3"), ("u1", "c1"), ("u2", "y")]


def test_mixed_corpus_and_metadata(spark):
    docs = spark.createDataFrame(
        [(1, "http://h/a", "<title>T</title><a href='b'>x</a>", None), (2, "http://h/j", '{"title":"J","url":"http://z"}', "application/JSON; x"), (3, "http://h/k", "{no", "application/json")],
        "id long, url string, html string, content_type string")
    records, broken = corpus.extract_any(docs)
    got = {r["id"]: (r["title"], r["extracted_links"], r["metadata"], r["content_type"]) for r in records.collect()}
    assert got == {1: ("T", ["http://h/b"], {}, "text/html"), 2: ("J", ["http://z"], {"source": "json"}, "application/json")}
    assert [r["id"] for r in broken.collect()] == [3]


def test_artifact_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("http://h/%d" % i, "<p>é%d</p>" % i) for i in range(5)], "normalized_url string, html string")
    raw = artifacts(pages, F.lit("job"))
    write_artifacts(raw.select("storage_key", "html"), str(tmp_path / "raw"), buckets=3)
    back = read_artifacts(spark, str(tmp_path / "raw"), raw.select("storage_key"), buckets=3)
    assert rows(back.select("html")) == rows(pages.select("html"))
    first = raw.first()
    assert first["size_bytes"] == len(first["html"].encode())
    folder = tmp_path / "files" / "job"
    folder.mkdir(parents=True)
    (folder / "abc.html").write_text("<p>x</p>")
    assert rows(read_html_files(spark, str(tmp_path / "files"))) == [("job/abc.html", "<p>x</p>")]


def test_frontier(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")]
    links = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([(1, "a"), (2, "c"), (2, "c")], "job_id long, normalized_url string")
    got = crawl.expand_frontier(seeds, links, 2)
    assert rows(got) == rows(spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "c", 0), (2, "d", 1), (2, "e", 2)], "job_id long, u string, depth int"))

    pages = [("http://a.com", ["http://b.com/1", "http://x.a.com/1", "http://a.com/2", "http://a.com/3"]), ("http://x.a.com/1", ["http://a.com", "http://a.com/9"])]
    outlinks = spark.createDataFrame(pages, "normalized_url string, extracted_links array<string>")
    seeds = spark.createDataFrame([(1, "http://a.com", 2, ["a.com"])], "job_id long, normalized_url string, max_depth int, allowed_domains array<string>")
    got = crawl.expand_corpus(seeds, outlinks, per_page=2)
    assert rows(got) == [(1, "http://a.com", 0), (1, "http://a.com/2", 1), (1, "http://a.com/9", 2), (1, "http://x.a.com/1", 1)]


def test_requests(spark):
    schema = "job_id int, seed_urls array<string>, max_depth int, allowed_domains array<string>, incremental boolean, recrawl_stale_hours int"
    df = spark.createDataFrame([(1, ["u"], 1, None, False, None), (2, None, 1, None, False, 24), (3, [], 1, [], True, 24), (4, ["u"], 11, None, False, 24), (5, [], 1, ["d"], True, 721)], schema)
    got = [r["reason"] for r in crawl.validate_requests(df).orderBy("job_id").collect()]
    assert got == [None, "seed_urls required unless incremental", "allowed_domains required for incremental jobs", "max_depth outside 0..10", "recrawl_stale_hours outside 1..720"]
    frontier = spark.createDataFrame([(1,)], "job_id int")
    out = crawl.reject_empty(crawl.validate_requests(df), frontier).orderBy("job_id").collect()
    assert (out[0]["urls_queued"], out[0]["reason"]) == (1, None)


def test_status_and_progress(spark):
    log = [(1, "u", "queued", None, None, 1), (1, "u", "failed", "e1", "c1", 2), (1, "u", "parsed", None, None, 3)]
    df = spark.createDataFrame(log, "job_id int, normalized_url string, status string, error string, checkpoint string, seq int")
    assert rows(crawl.current_status(df, ["seq"])) == [(1, "u", "parsed", "e1", "c1")]
    jobs = spark.createDataFrame([(1, "running", 9), (2, "running", 9), (3, "running", 9), (4, "pending", 1)], "id int, status string, urls_queued int")
    urls = spark.createDataFrame([(1, "parsed"), (1, "failed"), (2, "parsed"), (2, "queued"), (2, "claimed"), (4, "parsed")], "job_id int, status string")
    assert rows(accounting.refresh_jobs(jobs, urls).select("id", "status")) == [(1, "completed"), (2, "running"), (3, "running"), (4, "pending")]
    got = accounting.job_progress(jobs, urls).select("job_id", "progress_percent", "urls_queued")
    assert rows(got) == [(1, 100.0, 2), (2, 33.3, 3), (3, 0.0, 9), (4, 100.0, 1)]


def test_similarity_join_both_ways(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 6)))) for i in range(60)], "d long, text string")
    asked = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=3))) for i in range(7)], "q long, text string")
    near = search.similarity_join(docs, "d", "text", asked, "q", "text", 0.3)
    far = search.similarity_join(docs, "d", "text", asked, "q", "text", 0.3, max_rows=1)
    assert rows(near) == rows(far)

    def grams(t):
        return {f"  {w} "[i:i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = []
    for d, a in [tuple(r) for r in docs.collect()]:
        for q, b in [tuple(r) for r in asked.collect()]:
            x, y = grams(a), grams(b)
            s = len(x & y) / len(x | y) if x | y else 0.0
            if s >= 0.3:
                want.append((q, d, s))
    assert rows(near) == sorted(want, key=repr)


def test_metrics(spark):
    log = spark.createDataFrame([("a", at(60 * m + s)) for m in range(0, 12) for s in range(30)], "l string, ts timestamp")
    got = metrics.alerts(log, "ts", 0.4, 5, ["l"])
    assert [(r["breach_start"], r["fired_at"], r["breach_end"]) for r in got.collect()] == [(at(300), at(600), at(720))]
    values = spark.createDataFrame([("a", float(v)) for v in range(101)], "l string, v double")
    assert metrics.exact_quantile(values, "v", ["l"], 0.95).first()["quantile"] == 95.0
    hist = {r["le"]: r["events"] for r in metrics.histogram(values, "v", ["l"], metrics.CRAWL_BUCKETS).collect()}
    assert (hist["0.1"], hist["5.0"], hist["60.0"], hist["+Inf"]) == (1, 6, 61, 101)


def test_similarity_in_tasks_counts_without_a_join(spark):
    """Small query sides are counted where the documents are: equal to the join, and no pair of trigrams becomes a row."""
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, None), (3, ""), (4, "Quick-quick THE"), (5, "Ünïcode brown"), (None, "fox")], "d long, t string")
    asked = spark.createDataFrame([("a", "quick fox"), ("b", "brown"), ("c", None), ("e", "zzz")], "q string, u string")
    for threshold in (0.0, 0.1, 0.5):
        new = search.similarity_join(docs, "d", "t", asked, "q", "u", threshold)
        old = search.similarity_join(docs, "d", "t", asked, "q", "u", threshold, max_rows=0)
        assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect())) and new.columns == old.columns
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan
    twice = docs.unionByName(docs.where("d = 1"))
    new, old = (search.similarity_join(twice, "d", "t", asked, "q", "u", **x) for x in ({}, {"max_rows": 0}))
    assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
