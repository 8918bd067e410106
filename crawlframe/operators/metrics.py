"""Counters, histograms, rates, quantiles and alerts over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.operators.ordered import by_position, count_before

# Histogram bucket bounds in seconds.
CRAWL_BUCKETS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
SEARCH_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
# Alert rules as threshold per second and holding time in minutes.
ALERT_RULES = {"crawl_errors": (0.1, 5), "parser_errors": (0.05, 5), "dead_letters": (0.0, 2)}

MINUTE = 60
RATE_MINUTES = 5


def counters(log: DataFrame, *labels: str) -> DataFrame:
    """Events per label combination."""
    return log.groupBy(*labels).agg(F.count("*").alias("events"))


def _bucket_counts(value: Column, bounds: list[float]) -> list[Column]:
    return [F.count_if(value <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]


def histogram(log: DataFrame, value: str, labels: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts (le, events) per label combination, the open bucket included."""
    counts = log.groupBy(*labels).agg(*_bucket_counts(F.col(value), bounds), F.count(value).alias("_all"))
    entries = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("events")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("events")))
    return counts.select(*labels, F.explode(F.array(*entries)).alias("r")).select(*labels, "r.*")


def per_minute(log: DataFrame, ts: str, labels: list[str], *aggs: Column) -> DataFrame:
    """Aggregate per label and minute; the log is reduced before anything slides over it."""
    minute = F.date_trunc("minute", F.col(ts))
    return log.groupBy(*labels, minute.alias("minute")).agg(*aggs)


def slide(per_min: DataFrame, minutes: int) -> DataFrame:
    """Repeat each minute row for every window end it falls into."""
    ends = F.sequence(F.lit(1), F.lit(minutes))
    return per_min.select("*", F.explode(ends).alias("_k")).withColumn(
        "window_end", F.timestamp_seconds(F.unix_seconds("minute") + F.col("_k") * MINUTE)
    ).drop("_k")


def rates(log: DataFrame, ts: str, labels: list[str], minutes: int = RATE_MINUTES) -> DataFrame:
    """Events per second over the trailing minutes, at every full minute."""
    counted = per_minute(log, ts, labels, F.count("*").alias("n"))
    return slide(counted, minutes).groupBy(*labels, "window_end").agg(
        F.sum("n").alias("events"), (F.sum("n") / F.lit(minutes * MINUTE)).alias("rate")
    )


def interpolate(cumulative: list[Column], total: Column, bounds: list[float], q: float) -> Column:
    """Quantile from cumulative bucket counts, linear inside the bucket that holds the rank."""
    rank = total * q
    out = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        low = bounds[i - 1] if i else 0.0
        under = cumulative[i - 1] if i else F.lit(0)
        inside = F.lit(float(low)) + (bounds[i] - low) * (rank - under) / F.nullif(cumulative[i] - under, F.lit(0))
        out = F.when(cumulative[i] >= rank, inside).otherwise(out)
    return F.when(total > 0, out)


def window_quantile(log: DataFrame, ts: str, value: str, labels: list[str], bounds: list[float],
                    q: float = 0.95, minutes: int = RATE_MINUTES) -> DataFrame:
    """Quantile per trailing window from bucket counts, merged from per-minute histograms."""
    names = [f"_b{i}" for i in range(len(bounds))]
    minute_hist = per_minute(log, ts, labels, *_bucket_counts(F.col(value), bounds), F.count(value).alias("_all"))
    merged = slide(minute_hist, minutes).groupBy(*labels, "window_end").agg(
        *[F.sum(n).alias(n) for n in [*names, "_all"]]
    )
    estimate = interpolate([F.col(n) for n in names], F.col("_all"), bounds, q)
    return merged.select(*labels, "window_end", F.col("_all").alias("observations"), estimate.alias("quantile"))


def exact_quantile(log: DataFrame, value: str, labels: list[str], q: float = 0.95) -> DataFrame:
    """Exact interpolated quantile per label.

    Equal values are counted before the shuffle; running counts are carried across chunks by position in the order of the values, so
    a frequent label spreads evenly over tasks, however its values lie.
    """
    held = log.filter(F.col(value).isNotNull()).groupBy(*labels, value).agg(F.count("*").alias("_n"))
    counted = count_before(by_position(held, labels, [value]), labels, [value], F.col("_n"), "_upto", inclusive=True)
    upto = counted.join(counted.groupBy(*labels).agg(F.sum("_n").alias("_all")), labels)
    rank = (F.col("_all") - 1) * q
    ends = upto.groupBy(*labels).agg(
        F.min(F.when(F.col("_upto") > F.floor(rank), F.col(value))).alias("_lo"),
        F.min(F.when(F.col("_upto") > F.ceil(rank), F.col(value))).alias("_hi"),
        F.max(rank - F.floor(rank)).alias("_f"),
    )
    return ends.select(*labels, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"))


def alerts(log: DataFrame, ts: str, threshold: float, hold_minutes: int, labels: list[str] | None = None,
           minutes: int = RATE_MINUTES) -> DataFrame:
    """Intervals in which the trailing rate stayed above the threshold for the holding time.

    Only breaching minutes are kept; unbroken runs of them are the islands.
    """
    labels = labels or []
    breach = rates(log, ts, labels, minutes).filter(F.col("rate") > threshold)
    by_time = Window.partitionBy(*labels).orderBy("window_end")
    island = F.unix_seconds("window_end") - F.row_number().over(by_time) * MINUTE
    runs = breach.withColumn("_island", island).groupBy(*labels, "_island").agg(
        F.min("window_end").alias("breach_start"), F.max("window_end").alias("breach_end"),
        F.max("rate").alias("peak_rate"),
    )
    held = F.unix_seconds("breach_end") - F.unix_seconds("breach_start")
    return runs.filter(held >= hold_minutes * MINUTE).select(
        *labels, "breach_start",
        F.timestamp_seconds(F.unix_seconds("breach_start") + hold_minutes * MINUTE).alias("fired_at"),
        "breach_end", "peak_rate",
    )
