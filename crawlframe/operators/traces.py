"""Timelines of traces from the log of all stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.operators.ordered import CHUNK, before, by_position, count_before, join_carry

# The stages a URL passes, in order.
STAGES = ["crawler", "parser", "cleaner"]
GAP_SECONDS = 60.0


def _place(stage: Column, stages: list[str]) -> Column:
    """Number of the stage from 1; 0 for one that is not listed."""
    return F.array_position(F.array(*[F.lit(s) for s in stages]), stage)


def trace_hops(log: DataFrame, trace: str, ts: str, stage: str, event_id: str,
               gap_seconds: float = GAP_SECONDS, stages: list[str] | None = None) -> DataFrame:
    """The log in order of each trace: ``hop`` from 1, ``from_stage``, ``latency_us``, ``is_gap`` and ``is_backward`` are added.

    Order is (time, id); ids are unique. The first hop has no stage before it and no latency. A hop is backward if its stage
    comes before the last one's; unlisted and null stages are never backward. Rows without a trace or a time are left out. A trace of any length is cut by position:
    each chunk passes its last row on, so no task holds a whole trace.
    """
    stages = stages or STAGES
    order = [ts, event_id]
    known = log.where(F.col(trace).isNotNull() & F.col(ts).isNotNull())
    rows = count_before(by_position(known, [trace], order), [trace], order, F.lit(1), "hop", inclusive=True)
    here = F.struct(F.col(ts).alias("_t"), F.col(event_id).alias("_e"), F.col(stage).alias("_s"))
    carry = rows.groupBy(trace, CHUNK).agg(F.max(here).alias("_end"))
    carry = carry.withColumn("_carry", F.max("_end").over(before([trace]))).drop("_end")
    inside = Window.partitionBy(trace, CHUNK).orderBy(*order)
    last = F.coalesce(F.lag(here).over(inside), F.col("_carry"))
    rows = join_carry(rows, carry, [trace]).withColumn("_last", last)
    latency = F.unix_micros(F.col(ts)) - F.unix_micros("_last._t")
    place, prior = _place(F.col(stage), stages), _place(F.col("_last._s"), stages)
    return rows.withColumns({
        "from_stage": F.col("_last._s"),
        "latency_us": latency,
        "is_gap": F.coalesce(latency > int(gap_seconds * 1_000_000), F.lit(False)),
        "is_backward": F.coalesce((place > 0) & (place < prior), F.lit(False)),
    }).drop("_last", "_carry", CHUNK)


def trace_timelines(hops: DataFrame, trace: str, ts: str, stage: str, stages: list[str] | None = None) -> DataFrame:
    """One row per trace of ``trace_hops``: hops, first_at, last_at, duration_us, longest_us, gaps, backward, and the listed stages
    that are ``missing``, in their order. Everything is added up by each task before the shuffle."""
    stages = stages or STAGES
    seen = [F.coalesce(F.bool_or(F.col(stage) == s), F.lit(False)).alias(f"_{i}") for i, s in enumerate(stages)]
    out = hops.groupBy(trace).agg(
        F.count("*").alias("hops"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.max("latency_us").alias("longest_us"),
        F.count_if("is_gap").alias("gaps"), F.count_if("is_backward").alias("backward"), *seen,
    )
    absent = F.array_compact(F.array(*[F.when(~F.col(f"_{i}"), s) for i, s in enumerate(stages)]))
    return out.withColumns({
        "duration_us": F.unix_micros("last_at") - F.unix_micros("first_at"), "missing": absent,
    }).drop(*[f"_{i}" for i in range(len(stages))])
