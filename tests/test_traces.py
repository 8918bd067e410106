"""Timelines of traces and the ways past a claim, against step-by-step models."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crawlframe.operators import dedup, traces
from test_operators import at, rows

LOG = "trace string, ts timestamp, stage string, event_id long"


def hop_model(log, gap):
    out, last = set(), {}
    for trace, t, stage, i in sorted((x for x in log if x[0] is not None and x[1] is not None), key=lambda x: (x[0], x[1], x[3])):
        n, before, t0 = last.get(trace, (0, None, None))
        latency = None if t0 is None else (t - t0) * 1_000_000
        both = stage in traces.STAGES and before in traces.STAGES
        backward = both and traces.STAGES.index(stage) < traces.STAGES.index(before)
        out.add((trace, i, n + 1, before, latency, latency is not None and latency > gap * 1_000_000, backward))
        last[trace] = (n + 1, stage, t)
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_trace_hops(spark, parts):
    rnd = random.Random(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        pick = lambda: rnd.choice([*traces.STAGES, "retry", None])
        log = [("hot", rnd.randrange(0, 3000), pick(), i) for i in range(600)]
        log += [("still", 5, pick(), i) for i in range(600, 900)]  # all at one instant
        log += [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(0, 900, 50)]), pick(), i) for i in range(900, 960)]
        df = spark.createDataFrame([(k, None if t is None else at(t), s, i) for k, t, s, i in log], LOG)
        hops = traces.trace_hops(df, "trace", "ts", "stage", "event_id")
        got = rows(hops.select("trace", "event_id", "hop", "from_stage", "latency_us", "is_gap", "is_backward"))
        assert got == hop_model(log, 60)
        lines = {r["trace"]: r for r in traces.trace_timelines(hops, "trace", "ts", "stage").collect()}
        for name in ("hot", "still", "a", "b"):
            mine = [x for x in log if x[0] == name and x[1] is not None]
            model = [x for x in hop_model(log, 60) if x[0] == name]
            r = lines[name]
            assert (r["hops"], r["gaps"], r["backward"]) == (len(mine), sum(x[5] for x in model), sum(x[6] for x in model))
            assert r["duration_us"] == (max(x[1] for x in mine) - min(x[1] for x in mine)) * 1_000_000
            assert r["longest_us"] == max(x[4] for x in model if x[4] is not None)
            assert r["missing"] == [s for s in traces.STAGES if s not in {x[2] for x in mine}]
        assert len(lines) == 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_row_and_no_row(spark):
    df = spark.createDataFrame([("a", at(1), "parser", 1)], LOG)
    hops = traces.trace_hops(df, "trace", "ts", "stage", "event_id")
    assert rows(traces.trace_timelines(hops, "trace", "ts", "stage").select("hops", "longest_us", "duration_us", "missing")) == [(1, None, 0, ["crawler", "cleaner"])]
    none = traces.trace_hops(df.limit(0), "trace", "ts", "stage", "event_id")
    assert traces.trace_timelines(none, "trace", "ts", "stage").count() == 0


def test_ways_past_a_claim(spark):
    rnd = random.Random(5)
    log = [(i, rnd.choice("abc"), rnd.randrange(0, 60_000), rnd.choice([1, 1, 1, 2, None]), rnd.choice([False, False, False, False, None, True])) for i in range(500)]
    log += [(500 + i, "one", 0, a, f) for i, (a, f) in enumerate([(1, False), (1, False), (2, False), (1, True), (3, True)])]
    passed, held = set(), {}
    for i, k, t, attempt, forced in sorted(log, key=lambda x: (x[1], x[2], not x[4], x[0])):
        if forced:
            held.pop(k, None)
            passed.add((i,))
        elif (attempt or 1) > 1:
            passed.add((i,))
        elif k not in held or t >= held[k] + 3600:
            held[k] = t
            passed.add((i,))
    df = spark.createDataFrame([(i, k, at(t), a, f) for i, k, t, a, f in log], "event_id long, k string, ts timestamp, attempt int, force boolean")
    assert rows(dedup.pass_claims(df, "k", "ts", "event_id", "attempt", "force")) == sorted(passed, key=repr)


def test_the_rows_tell_something(spark):
    """The registered queries meet gaps, steps back, missing stages, retries and forced fetches on the given tables."""
    q, d = entry.queries(), "/root/testdata/sf0.001"
    lines = q["trace_timelines"](spark, d)
    kinds = lines.agg(*[F.count_distinct(c) for c in ("hops", "gaps", "backward", "missing", "longest_us")]).first()
    assert min(kinds) > 1
    plain, more = (q[n](spark, d).groupBy("outcome").count() for n in ("fetch_outcome", "fetch_outcome_attempts"))
    assert rows(plain) != rows(more)
