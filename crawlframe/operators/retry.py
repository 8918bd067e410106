"""Retry decisions, failure routing, re-emission and dead-letter replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.operators.ordered import CHUNK, before, by_position, join_carry

# Retry and replay limits.
MAX_ATTEMPTS = 5
BASE_DELAY_SECONDS = 1.0
MAX_REPLAYS = 3
REPLAY_TTL_SECONDS = 86400


def decide(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS, base_delay: float = BASE_DELAY_SECONDS) -> DataFrame:
    """Add should_retry, delay_seconds and reason from attempt and error."""
    spent = F.col("attempt") >= max_attempts
    return failures.withColumns({
        "should_retry": ~spent,
        "delay_seconds": F.when(spent, F.lit(0.0)).otherwise(F.lit(base_delay) * F.pow(F.lit(2.0), F.col("attempt") - 1)),
        "reason": F.when(spent, F.concat(F.lit("max attempts reached: "), F.col("error"))).otherwise(F.col("error")),
    })


def route(failures: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(failures to retry, failures for the dead-letter topic)."""
    decided = decide(failures, **limits)
    return decided.filter("should_retry"), decided.filter(~F.col("should_retry"))


def due_at(ts: str = "timestamp") -> Column:
    """Time at which a retried failure is sent again."""
    return F.timestamp_micros(F.unix_micros(F.col(ts)) + (F.col("delay_seconds") * 1_000_000).cast("long"))


def reemit(retries: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Retried failures as the next attempt: a page event for the cleaner stage with a payload,
    else a URL event. Other fields are carried over."""
    page = (F.col("stage") == "cleaner") & (F.coalesce(F.col("page_payload"), F.lit("")) != "")
    return retries.withColumns({
        "topic": F.when(page, "page.parsed").otherwise("url.discovered"),
        "attempt": F.col("attempt") + 1,
        "retry_at": due_at(ts),
    })


def replay_numbers(letters: DataFrame, key: str, ts: str, order: list[str],
                   ttl_seconds: int = REPLAY_TTL_SECONDS) -> DataFrame:
    """Add replay_no: the count of letters of an id since its counter last expired.

    The counter expires ``ttl_seconds`` after its latest increment, so a longer gap starts a new
    run. Row numbers and run starts are carried across chunks by position: the id of letters without one
    may be shared by a large part of all rows.
    """
    ttl = ttl_seconds * 1_000_000
    keys = [key]
    rows = by_position(letters.withColumn("_t", F.unix_micros(F.col(ts))), keys, [ts, *order])
    inside = Window.partitionBy(key, CHUNK).orderBy(ts, *order)
    local = rows.withColumns({
        "_n": F.row_number().over(inside), "_gap": F.col("_t") - F.lag("_t").over(inside),
    }).withColumn("_start", F.when(F.col("_gap") >= ttl, F.col("_n")))
    summary = (
        local.groupBy(key, CHUNK).agg(
            F.count("*").alias("_rows"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"),
            F.max("_start").alias("_last_start"),
        )
        .withColumn("_skip", F.coalesce(F.sum("_rows").over(before(keys)), F.lit(0)))
        .withColumn("_prev", F.max("_hi").over(before(keys)))
    )
    opens = F.col("_prev").isNull() | (F.col("_lo") - F.col("_prev") >= ttl)
    summary = summary.withColumn(
        "_own", F.col("_skip") + F.coalesce("_last_start", F.when(opens, F.lit(1)))
    ).withColumn("_opens", opens)
    carried = F.last("_own", ignorenulls=True).over(before(keys))
    summary = summary.withColumn(
        "_entry", F.when(F.col("_opens"), F.col("_skip") + 1).otherwise(carried)
    ).select(key, CHUNK, "_skip", "_entry")
    running = F.max("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    joined = join_carry(local.withColumn("_run", running), summary, keys)
    begin = F.coalesce(F.col("_skip") + F.col("_run"), F.col("_entry"))
    return joined.withColumn("replay_no", F.col("_skip") + F.col("_n") - begin + 1).drop(
        CHUNK, "_t", "_n", "_gap", "_start", "_run", "_skip", "_entry"
    )


def payload_shape(payload: Column) -> Column:
    """Kind of event a dead letter holds, from the keys that are present."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))

    def has(*names: str) -> Column:
        test = F.lit(True)
        for n in names:
            test = test & F.array_contains(keys, n)
        return test

    return (
        F.when(has("storage_key", "checksum", "extracted_links"), "page")
        .when(has("normalized_url", "job_id"), "url")
        .otherwise("unrecognized")
    )


def payload_usable(payload: Column, shape: Column) -> Column:
    """True if the fields that the event needs have values."""
    def value(name: str) -> Column:
        return F.get_json_object(payload, f"$.{name}")

    base = value("job_id").isNotNull() & value("url").isNotNull() & value("normalized_url").isNotNull()
    return F.when(shape == "page", base & value("storage_key").isNotNull() & value("checksum").isNotNull()).otherwise(base)


def replay(letters: DataFrame, ts: str, order: list[str], max_replays: int = MAX_REPLAYS, **limits) -> DataFrame:
    """Dead letters (error, payload) -> result and, for a success, the topic it goes back to.

    URL events are replayed by force. A letter over the cap still counts for the expiry.
    """
    keyed = letters.withColumn("event_id", F.coalesce(F.get_json_object("payload", "$.event_id"), F.lit("unknown")))
    counted = replay_numbers(keyed, "event_id", ts, order, **limits)
    shaped = counted.withColumn("shape", payload_shape(F.col("payload")))
    result = (
        F.when(F.col("replay_no") > max_replays, "cap_exceeded")
        .when(F.col("shape") == "unrecognized", "unrecognized")
        .when(~payload_usable(F.col("payload"), F.col("shape")), "error")
        .otherwise("success")
    )
    return shaped.withColumn("result", result).withColumns({
        "topic": F.when(F.col("result") == "success", F.when(F.col("shape") == "page", "page.parsed").otherwise("url.discovered")),
        "force_recrawl": (F.col("result") == "success") & (F.col("shape") == "url"),
    })


def outcome_counts(rows: DataFrame, *labels: str) -> DataFrame:
    """Events per label combination."""
    return rows.groupBy(*labels).agg(F.count("*").alias("events"))
