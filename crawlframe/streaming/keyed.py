"""Keyed state: TTL claims, replay counters, token buckets and delayed re-emission.

Times are microseconds of event time. The state keeps event times and compares them; the state
TTL, which runs on processing time, only clears keys that have gone quiet. Rows of a key are
handled in time order inside a micro-batch, whose size the source bounds; between batches the
order is that of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from crawlframe.streaming.runtime import use_rocksdb

_ONE_LONG = T.StructType([T.StructField("t", T.LongType())])


def _in_order(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


class Claims(StatefulProcessor):
    """Set-if-absent with an expiry anchored at the accepted claim; a forced row clears it."""

    def __init__(self, key: str, ttl_us: int, cleanup_ms: int):
        self.key, self.ttl, self.cleanup = key, ttl_us, cleanup_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last_claim", _ONE_LONG, ttlDurationMs=self.cleanup)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = _in_order(rows, "t", "plain")
        held = self.last.get()[0] if self.last.exists() else None
        times, forced, taken = data["t"].to_numpy(), data["forced"].to_numpy(), []
        i = 0
        while i < len(times):
            if forced[i]:
                held = None
                taken.append((int(times[i]), True))
                i += 1
            elif held is None or times[i] >= held + self.ttl:
                held = int(times[i])
                taken.append((held, False))
                i += 1
            else:
                # Skip to the next time that can be accepted, or to the next forced row.
                ahead = int(np.searchsorted(times, held + self.ttl))
                jump = np.flatnonzero(forced[i:ahead])
                i = i + int(jump[0]) if len(jump) else max(ahead, i + 1)
        if held is None:
            self.last.clear()
        else:
            self.last.update((held,))
        yield pd.DataFrame({
            self.key: [key[0]] * len(taken), "t": [t for t, _ in taken], "forced": [f for _, f in taken],
        })

    def close(self) -> None:
        pass


class ReplayCounter(StatefulProcessor):
    """Count per id that starts again after a gap of ``ttl_us``; every row refreshes the expiry."""

    def __init__(self, ttl_us: int, cleanup_ms: int):
        self.ttl, self.cleanup = ttl_us, cleanup_ms

    def init(self, handle) -> None:
        schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.LongType())])
        self.count = handle.getValueState("replays", schema, ttlDurationMs=self.cleanup)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = _in_order(rows, "t", "seq")
        n, t = tuple(self.count.get()) if self.count.exists() else (0, None)
        times = data["t"].to_numpy()
        previous = np.concatenate([[times[0] if t is None else t], times[:-1]])
        starts = (times - previous) >= self.ttl
        begin = np.maximum.accumulate(np.where(starts, np.arange(len(times)), -1))
        numbers = np.where(begin >= 0, np.arange(len(times)) - begin + 1, np.arange(len(times)) + n + 1)
        self.count.update((int(numbers[-1]), int(times[-1])))
        yield pd.DataFrame({"seq": data["seq"], "event_id": key[0], "replay_no": numbers})

    def close(self) -> None:
        pass


class TokenBucket(StatefulProcessor):
    """Earliest dispatch per request; the state is the time at which the bucket is full again."""

    def __init__(self, key: str, gap_us: float, burst: int, cleanup_ms: int):
        self.key, self.gap, self.burst, self.cleanup = key, gap_us, burst, cleanup_ms

    def init(self, handle) -> None:
        schema = T.StructType([T.StructField("full_at", T.DoubleType())])
        self.full_at = handle.getValueState("bucket", schema, ttlDurationMs=self.cleanup)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = _in_order(rows, "t", "seq")
        held = self.full_at.get()[0] if self.full_at.exists() else -np.inf
        times = data["t"].to_numpy(dtype="float64")
        n = np.arange(len(times))
        # Full-again time before each row: the running maximum of t - n*gap, shifted by n*gap.
        heads = np.maximum.accumulate(np.concatenate([[held], times - n * self.gap]))
        before = heads[:-1] + n * self.gap
        dispatch = np.maximum(times, before - (self.burst - 1) * self.gap)
        self.full_at.update((float(heads[-1] + len(times) * self.gap),))
        yield pd.DataFrame({"seq": data["seq"], self.key: key[0], "wait_us": np.rint(dispatch - times).astype("int64")})

    def close(self) -> None:
        pass


class DelayedRetry(StatefulProcessor):
    """Hold each failure until its retry time, then send it on; runs on processing time."""

    def init(self, handle) -> None:
        schema = T.StructType([T.StructField("due_ms", T.LongType()), T.StructField("body", T.StringType())])
        self.handle = handle
        self.waiting = handle.getListState("waiting", schema)

    def _split(self, now: int):
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        return [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]

    def _emit(self, key, due) -> Iterator[pd.DataFrame]:
        if due:
            yield pd.DataFrame({"retry_key": key[0], "due_ms": [r[0] for r in due], "body": [r[1] for r in due]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due = []
        for chunk in rows:
            for due_ms, body in zip(chunk["due_ms"], chunk["body"]):
                if due_ms <= now:
                    due.append((int(due_ms), body))
                else:
                    self.waiting.appendValue((int(due_ms), body))
                    self.handle.registerTimer(int(due_ms))
        yield from self._emit(key, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, later = self._split(expiredTimerInfo.getExpiryTimeInMs())
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        yield from self._emit(key, due)

    def close(self) -> None:
        pass


def claims_stream(events: DataFrame, key: str, ts: str, ttl_seconds: int, force=None, quiet_factor: int = 24) -> DataFrame:
    """Accepted claims (key, ts, forced) of a stream."""
    use_rocksdb(events.sparkSession)
    forced = F.lit(False) if force is None else F.coalesce(force, F.lit(False))
    slim = events.select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), forced.alias("forced"))
    slim = slim.withColumn("plain", ~F.col("forced"))
    schema = T.StructType([slim.schema[key], T.StructField("t", T.LongType()), T.StructField("forced", T.BooleanType())])
    out = slim.groupBy(key).transformWithStateInPandas(
        Claims(key, ttl_seconds * 1_000_000, ttl_seconds * 1000 * quiet_factor), schema, "append", "processingTime"
    )
    return out.select(key, F.timestamp_micros("t").alias(ts), "forced")


def replay_stream(letters: DataFrame, ts: str, ttl_seconds: int = 86400, quiet_factor: int = 7) -> DataFrame:
    """(seq, event_id, replay_no) of a stream of dead letters with columns event_id and seq."""
    use_rocksdb(letters.sparkSession)
    slim = letters.select("event_id", "seq", F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    return slim.groupBy("event_id").transformWithStateInPandas(
        ReplayCounter(ttl_seconds * 1_000_000, ttl_seconds * 1000 * quiet_factor),
        "seq long, event_id string, replay_no long", "append", "processingTime",
    )


def politeness_stream(arrivals: DataFrame, domain: str, ts: str, seq: str, rate: float = 1.0, burst: int = 5,
                      quiet_seconds: int = 86400) -> DataFrame:
    """(seq, domain, wait_us) of a stream of requests."""
    use_rocksdb(arrivals.sparkSession)
    slim = arrivals.select(F.col(domain), F.col(seq).cast("long").alias("seq"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    schema = T.StructType([T.StructField("seq", T.LongType()), slim.schema[domain], T.StructField("wait_us", T.LongType())])
    cleanup = int((burst / rate + quiet_seconds) * 1000)
    return slim.groupBy(domain).transformWithStateInPandas(
        TokenBucket(domain, 1_000_000.0 / rate, burst, cleanup), schema, "append", "processingTime"
    )


def delayed_retries(retries: DataFrame, key: str, retry_at: str, lanes: int = 64) -> DataFrame:
    """Failures as (retry_key, due_ms, body) once their retry time has come.

    The URL is hashed into lanes with a share of the failure's own hash, so one failing URL or site
    does not gather in a single state key.
    """
    use_rocksdb(retries.sparkSession)
    body = F.to_json(F.struct("*"))
    slim = retries.select(
        F.concat_ws("/", F.col(key), F.pmod(F.xxhash64(body), F.lit(lanes)).cast("string")).alias("retry_key"),
        F.unix_millis(F.col(retry_at)).alias("due_ms"), body.alias("body"),
    )
    return slim.groupBy("retry_key").transformWithStateInPandas(
        DelayedRetry(), "retry_key string, due_ms long, body string", "append", "processingTime"
    )
