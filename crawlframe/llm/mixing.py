"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.common import stored, table

#: A result of at most this many sources is sent to all executors.
FEW_SOURCES = 10_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities from 0 on, up to where the rest is beyond the uniform numbers' grain."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    walk = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-rate).alias("log_p"), F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf")),
        lambda a, k: F.struct(
            (a["log_p"] + F.log(rate) - F.log(k.cast("double"))).alias("log_p"),
            (a["p"] + F.exp(a["log_p"] + F.log(rate) - F.log(k.cast("double")))).alias("p"),
            F.concat(a["cdf"], F.array(a["p"] + F.exp(a["log_p"] + F.log(rate) - F.log(k.cast("double"))))).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )
    return F.when(rate > 0, walk)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """Mean repetitions per source: ``src``, ``mass`` (code points), ``rate``, ``cdf``.

    ``weights`` gives each source's share of the mixed code points (scaled to sum 1; a source without weight gets none);
    None gives all sources equal shares. The mixture aims at ``epochs`` times the corpus. A null source is a source of
    its own (weight key ``""``); a source without text keeps rate ``epochs``.
    """
    mass = docs.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("mass"))
    if weights is None:
        share = F.lit(1.0)
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.create_map(*pairs)[F.col("src")], F.lit(0.0)) if pairs else F.lit(0.0)
    whole = mass.withColumn("share", share)
    whole = stored(whole, "source-mass")
    sums = whole.agg(F.sum("mass").alias("mass"), F.sum(F.when(F.col("mass") > 0, F.col("share"))).alias("share")).first()
    scale = epochs * (sums["mass"] or 0) / (sums["share"] or 1.0)
    rate = F.when(F.col("mass") > 0, scale * F.col("share") / F.col("mass")).otherwise(float(epochs))
    rated = whole.select("src", "mass", rate.alias("rate"))
    return rated.withColumn("cdf", poisson_steps(F.col("rate")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """Repeat every document as often as a Poisson draw with its source's rate says, and shuffle all copies globally.

    The draw inverts the Poisson distribution at a number hashed from seed and doc_id, so it is the same on every run and
    on every retry. Adds ``copy`` (0, 1, ...) and ``mix_key`` (the place in the shuffled order: copies are dealt over the
    partitions by it and sorted by it). Rows of equal doc_id get equal counts; a null doc_id draws as the text "null".
    Null and empty texts are repeated like others. An empty table gives an empty result. Other columns are kept.
    """
    rates = source_rates(docs, weights, epochs).select("src", "cdf")
    small = rates.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    src = F.coalesce(docs["source"], F.lit(""))
    joined = docs.join(F.broadcast(rates) if small else rates, src == rates["src"], "left")
    who = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    draw = uniform(F.lit(str(seed)), who)
    times = F.coalesce(F.size(F.filter(rates["cdf"], lambda c: c <= draw)), F.lit(0))
    copies = joined.select(
        *[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(0), times)).alias("copy"), times.alias("_times")
    ).where("copy < _times").drop("_times")
    copies = copies.withColumn("mix_key", F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string"), F.lit("order"))))
    return copies.repartition("mix_key").sortWithinPartitions("mix_key")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """One epoch of the documents with equal shares of all sources, texts included."""
    return mix(table(spark, folder, "documents").select("doc_id", "source", "text"))


ORACLE_MIX = """
WITH m AS (SELECT coalesce(source, '') AS src, sum(coalesce(length(text), 0)) AS mass FROM documents GROUP BY 1),
r AS (SELECT src, CASE WHEN mass > 0 THEN (SELECT sum(mass) FROM m)::DOUBLE / (SELECT count(*) FROM m WHERE mass > 0) / mass
             ELSE 1.0 END AS rate FROM m),
p AS (SELECT src, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p
      FROM r, range(0, 2000) t(k) WHERE k <= ceil(rate + 10 * sqrt(rate) + 30)),
c AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS cdf FROM p),
u AS (SELECT doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS who,
             CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM documents),
n AS (SELECT doc_id, source, text, who, (SELECT count(*) FROM c WHERE c.src = coalesce(u.source, '') AND cdf <= u.u) AS times FROM u)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, md5('0:' || who || ':' || copy || ':order') AS mix_key
FROM (SELECT *, unnest(range(0, times)) AS copy FROM n)
"""
