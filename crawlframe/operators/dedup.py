"""Ledgers, TTL claims and content-change detection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions.lang import unnest
from crawlframe.operators.ordered import CHUNK, by_position, count_before, join_carry
from crawlframe.session import durable, small_or_shuffled

HOUR = 3600
DAY = 86400


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order; partial aggregation runs before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_r"))
    return picked.select("_r.*")


def ledger(events: DataFrame, order: list[str], history: DataFrame | None = None,
           keys: tuple[str, ...] = ("event_id", "stage")) -> DataFrame:
    """Events that are the first of their ledger key and not in the history."""
    fresh = events
    if history is not None:
        fresh = events.join(history.select(*keys).distinct(), list(keys), "left_anti")
    return earliest(fresh, list(keys), order)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing rows plus the first incoming row of every new key."""
    new = earliest(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)


def _fold_claims(times: Column, ttl: int) -> Column:
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit([]).cast("array<bigint>").alias("taken"))
    return F.aggregate(
        times,
        start,
        lambda acc, t: F.when(
            acc["last"].isNull() | (t >= acc["last"] + ttl),
            F.struct(t.alias("last"), F.concat(acc["taken"], F.array(t)).alias("taken")),
        ).otherwise(acc),
        lambda acc: acc["taken"],
    )


def _successors(times: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """For each time of a key, the first time of the key at least ``ttl`` later.

    Work is cut into (key, ttl bucket) pieces: a probe placed at t + ttl looks forward inside its
    bucket, else takes the first time of the next filled bucket.
    """
    bucket = F.floor(F.col("pos") / F.lit(ttl))
    points = times.select(*keys, F.col("t").alias("pos"), F.col("t").alias("at"), F.lit(None).cast("long").alias("of"))
    probes = times.select(*keys, (F.col("t") + ttl).alias("pos"), F.lit(None).cast("long").alias("at"), F.col("t").alias("of"))
    both = points.unionByName(probes).withColumn(CHUNK, bucket)
    ahead = Window.partitionBy(*keys, CHUNK).orderBy(F.desc("pos"), F.col("of").isNotNull()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = both.withColumn("_next", F.min("at").over(ahead)).filter(F.col("of").isNotNull())
    later = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
    carry = (
        both.groupBy(*keys, CHUNK).agg(F.min("at").alias("_first"))
        .withColumn("_carry", F.min("_first").over(later)).drop("_first")
    )
    return join_carry(local, carry, keys).select(
        *keys, F.col("of").alias("t"), F.coalesce("_next", "_carry").alias("nxt")
    )


def _chase_claims(times: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Claims of large keys by pointer doubling over the successor links.

    Every round doubles the number of known claims with joins on (key, time), which spread evenly.
    """
    span = times.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    longest = span.agg(F.max(F.col("b") - F.col("a")).alias("s")).first()["s"] or 0
    rounds = max(1, math.ceil(math.log2(longest // ttl + 2)))
    jump = durable(_successors(times, keys, ttl))
    reached = times.groupBy(*keys).agg(F.min("t").alias("t"))
    for i in range(rounds):
        step = reached.join(jump, [*keys, "t"]).filter(F.col("nxt").isNotNull())
        reached = durable(reached.unionByName(step.select(*keys, F.col("nxt").alias("t"))))
        if i + 1 < rounds:
            onward = jump.select(*keys, F.col("t").alias("nxt"), F.col("nxt").alias("far"))
            jump = durable(
                jump.join(onward, [*keys, "nxt"]).filter(F.col("far").isNotNull())
                .select(*keys, "t", F.col("far").alias("nxt"))
            )
    return reached


def ttl_claims(events: DataFrame, key: str, ts: str, ttl_seconds: int = DAY,
               force: str | None = None, hot_rows: int = 50_000) -> DataFrame:
    """Accepted claims (key, ts): set-if-absent with an expiry anchored at the accepted claim.

    A forced event is always accepted and clears the claim without taking it. Keys with up to
    ``hot_rows`` distinct times are folded in place; larger ones are chased across tasks.
    """
    ttl = ttl_seconds * 1_000_000
    micros = F.unix_micros(F.col(ts)).alias("t")
    if force is None:
        times = events.filter(F.col(ts).isNotNull()).groupBy(F.col(key).alias("k"), micros).agg(
            F.lit(0).alias("seg")
        )
        forced = None
    else:
        # At one instant a forced event comes first, so the plain one meets a cleared claim.
        merged = events.filter(F.col(ts).isNotNull()).groupBy(F.col(key).alias("k"), F.col(ts).alias("ts")).agg(
            F.coalesce(F.bool_or(F.col(force)), F.lit(False)).alias("f"),
            F.coalesce(F.bool_or(~F.coalesce(F.col(force), F.lit(False))), F.lit(False)).alias("plain"),
        )
        cut = count_before(
            by_position(merged, ["k"], ["ts"]), ["k"], ["ts"],
            F.col("f").cast("int"), "seg", inclusive=True,
        )
        times = cut.filter("plain").select("k", F.unix_micros("ts").alias("t"), "seg")
        forced = merged.filter("f").select("k", F.unix_micros("ts").alias("t"), F.lit(True).alias("forced"))

    keys = ["k", "seg"]
    sizes = times.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > hot_rows).select(*keys)
    has_hot = bool(hot.head(1))
    cold_times = times
    if has_hot:
        hot = small_or_shuffled(durable(hot))
        cold_times = times.join(hot, keys, "left_anti")
    claims = (
        cold_times.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .transform(unnest, _fold_claims(F.col("ts"), ttl), "t", keep=keys)
    )
    if has_hot:
        claims = claims.unionByName(
            _chase_claims(durable(times.join(hot, keys, "left_semi")), keys, ttl).select(*keys, "t")
        )
    claims = claims.select("k", "t", F.lit(False).alias("forced"))
    if forced is not None:
        claims = claims.unionByName(forced)
    return claims.select(F.col("k").alias(key), F.timestamp_micros("t").alias(ts), "forced")


def claim_winners(events: DataFrame, key: str, ts: str, event_id: str, ttl_seconds: int = DAY) -> DataFrame:
    """Ids of the events that take the claim of their key; of several at one instant the smallest id does."""
    first = events.groupBy(key, ts).agg(F.min(event_id).alias(event_id))
    return first.join(ttl_claims(events, key, ts, ttl_seconds).select(key, ts), [key, ts]).select(event_id)


def pass_claims(events: DataFrame, key: str, ts: str, event_id: str, attempt: str, force: str, ttl_seconds: int = HOUR) -> DataFrame:
    """Ids of the events that go on to be fetched: those that take their key's claim, retries and forced ones.

    A retry (attempt above 1) neither asks for the claim that its first attempt holds nor changes it. A forced event passes and
    releases the claim; at one instant it comes first. Null attempts are first ones, null flags are not forced.
    """
    forced = F.coalesce(F.col(force), F.lit(False))
    again = ~forced & (F.coalesce(F.col(attempt), F.lit(1)) > 1)
    claims = ttl_claims(events.where(~again), key, ts, ttl_seconds, force).where(~F.col("forced")).select(key, ts)
    first = events.where(~forced & ~again).groupBy(key, ts).agg(F.min(event_id).alias(event_id))
    return first.join(claims, [key, ts]).select(event_id).unionByName(events.where(forced | again).select(event_id))


def claim_batch(events: DataFrame, held: DataFrame, key: str, ts: str, event_id: str, ttl_seconds: int = DAY,
                force: str | None = None) -> DataFrame:
    """Claims of a micro-batch against the claims held so far (key, claimed_at; null if released).

    One row per key of the batch: ``passed``, the ids of the events that pass, and ``claimed_at``, the claim held from now on.
    A forced event passes and releases the claim; at one instant forced events come first. Of several plain events at one instant the
    smallest id passes. A key's distinct instants of one batch are folded in one row, so the source must bound the batch.
    """
    ttl = ttl_seconds * 1_000_000
    forced = F.lit(False) if force is None else F.coalesce(F.col(force), F.lit(False))
    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col(ts)).alias("t"), F.col(event_id).alias("e"), forced.alias("f"))
    instants = rows.groupBy("k", "t", "f").agg(F.min("e").alias("e"), F.collect_list(F.when(F.col("f"), F.col("e"))).alias("all"))
    listed = instants.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", (~F.col("f")).alias("plain"), "e", "all"))).alias("rows"))
    listed = listed.join(held.select(F.col(key).alias("k"), F.unix_micros("claimed_at").alias("prior")), "k", "left")
    state = lambda claim, passed: F.struct(claim.cast("bigint").alias("claim"), passed.alias("passed"))
    folded = F.aggregate(
        "rows", state(F.col("prior"), F.array().cast("array<string>")),
        lambda acc, r: F.when(~r["plain"], state(F.lit(None), F.concat(acc["passed"], r["all"])))
        .when(acc["claim"].isNull() | (r["t"] >= acc["claim"] + ttl), state(r["t"], F.concat(acc["passed"], F.array(r["e"]))))
        .otherwise(acc))
    out = listed.select("k", folded.alias("r"))
    return out.select(F.col("k").alias(key), F.col("r.passed").alias("passed"), F.timestamp_micros("r.claim").alias("claimed_at"))


def content_changes(fetched: DataFrame, stored: DataFrame, html: str = "html") -> DataFrame:
    """Compare each fetched page with the stored hash of its canonical URL: new, changed, unchanged.

    Pages come with their ``checksum`` or with their HTML, which is hashed before anything is shuffled.
    """
    known = stored.select("normalized_url", F.col("content_hash").alias("stored_hash"))
    hashed = fetched if "checksum" in fetched.columns else fetched.withColumn("checksum", F.sha2(F.col(html), 256)).drop(html)
    compared = hashed.join(known, "normalized_url", "left")
    absent = F.coalesce(F.col("stored_hash"), F.lit("")) == ""
    return compared.withColumn(
        "change",
        F.when(absent, "new").when(F.col("stored_hash") == F.col("checksum"), "unchanged").otherwise("changed"),
    )


def touch_unchanged(urls: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Set last_crawled_at of the URLs whose page did not change; other rows stay as they are."""
    seen = changes.filter(F.col("change") == "unchanged").select("normalized_url").distinct()
    return (
        urls.join(seen.withColumn("_seen", F.lit(True)), "normalized_url", "left")
        .withColumn("last_crawled_at", F.when(F.col("_seen"), now).otherwise(F.col("last_crawled_at")))
        .drop("_seen")
    )
