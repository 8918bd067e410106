"""Stand-in tables: the given tables in the shape the operators expect.

Each binding reads whole tables; ``sql_text.py`` states the same tables for the SQL check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.functions.urls import domain_of, normalize_url
from crawlframe.operators.dedup import earliest
from crawlframe.session import small_or_shuffled, spread
from crawlframe.sources.tables import read_table, storage_key

NOW = "2001-08-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def flat(df: DataFrame) -> DataFrame:
    """Comparable output: whole numbers as bigint, times as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    return df.select(*out)


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "pages"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents"))


def canonical_pages(spark: SparkSession, d: str, *extra) -> DataFrame:
    """One page per canonical URL: the one with the smallest id.

    Only the ``extra`` columns are carried through the aggregation besides id and URLs: hashes, sizes or links of a page,
    taken while it is scanned, never its HTML.
    """
    named = pages(spark, d).select("page_id", "url", normalize_url("url").alias("normalized_url"), *extra)
    return earliest(named, ["normalized_url"], ["page_id"])


def canonical_html(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, normalized_url and html of the same pages; they are chosen by id and only then read whole."""
    chosen = canonical_pages(spark, d).select("page_id", "normalized_url")
    return pages(spark, d).join(small_or_shuffled(chosen), "page_id").select("page_id", "url", "normalized_url", "html")


def html_on_demand(chosen: DataFrame, pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """From wanted URLs (``_url``) to normalized_url and html of their pages, by the ids in ``chosen`` (page_id, normalized_url).

    Only ids meet the wanted URLs. ``pages`` is then scanned for those ids; unless they are very many, no HTML is shuffled.
    """
    def of(wanted: DataFrame) -> DataFrame:
        ids = chosen.join(wanted, F.col("normalized_url") == F.col("_url"), "left_semi")
        return pages.select("page_id", "html").join(small_or_shuffled(ids), "page_id").select("normalized_url", "html")

    return of


def hashed_pages(spark: SparkSession, d: str, job: str) -> DataFrame:
    """The same pages with storage_key, checksum and size_bytes."""
    chosen = canonical_pages(spark, d, F.sha2("html", 256).alias("checksum"), F.octet_length("html").alias("size_bytes"))
    return chosen.withColumn("storage_key", storage_key(F.lit(job), F.col("normalized_url")))


def urls(spark: SparkSession, d: str) -> DataFrame:
    """URL table of the pages; state and times come from the order of the same number."""
    o = read_table(spark, d, "orders")
    u = canonical_pages(spark, d, F.sha2("html", 256).alias("content_hash"))
    status = (
        F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "O", "fetched")
        .when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    )
    return u.join(o, u.page_id == o.o_orderkey, "left").select(
        F.col("page_id").alias("id"), F.col("o_custkey").alias("job_id"),
        F.col("url").alias("canonical_url"), "normalized_url",
        domain_of(F.col("normalized_url")).alias("domain"), status.alias("status"),
        "content_hash", (F.col("page_id") % 4).cast("int").alias("depth"),
        F.col("o_orderdate").alias("last_crawled_at"), F.col("o_orderdate").alias("created_at"),
    )


def jobs(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "pending").otherwise("running").alias("status"),
        F.col("c_nationkey").alias("urls_queued"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("c_custkey") * 7919, F.lit(100003)) * 60).alias("created_at"),
    )


def job_urls(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    status = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "claimed")
        .when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "P", "failed")
        .when(F.col("o_orderpriority") == "5-LOW", "skipped").otherwise("queued")
    )
    return o.select(
        F.col("o_custkey").alias("job_id"),
        F.concat(F.lit("https://shop.example.com/"), F.col("o_orderkey").cast("string")).alias("normalized_url"),
        F.lit(0).alias("depth"), status.alias("status"), F.col("o_orderdate").alias("updated_at"),
    )


def schedules(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("*/"), (F.col("s_nationkey") + 1).cast("string"), F.lit(" * * * *")).alias("cron_expression"),
        (F.col("s_acctbal") > 0).alias("enabled"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("s_suppkey") * 7919, F.lit(10007)) * 60).alias("created_at"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    """Event log with the number in ``props`` as ``k``."""
    e = read_table(spark, d, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def link_table(spark: SparkSession, d: str) -> DataFrame:
    """Edges between parts and their suppliers, both ways."""
    li = read_table(spark, d, "lineitem")
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    supp = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    pos = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    both = F.array(
        F.struct(part.alias("src"), supp.alias("dst"), pos.alias("pos")),
        F.struct(supp.alias("src"), part.alias("dst"), pos.alias("pos")),
    )
    return li.select(F.explode(both).alias("e")).select("e.*")


def robots(spark: SparkSession, d: str) -> DataFrame:
    """One robots.txt per host of the corpus; its form follows from the host name."""
    named = pages(spark, d).select(domain_of(normalize_url("url")).alias("site")).distinct()
    kind = F.length("site") % 3
    text = (
        F.when(kind == 0, "User-agent: *\nAllow: /en/4\nDisallow: /en/\n")
        .when(kind == 1, "User-agent: otherbot\nDisallow: /\n\nUser-agent: CrawlFrame\nDisallow: /fr\nDisallow: /es/\n"
                         "\nUser-agent: *\nDisallow: /\n")
        .otherwise("")
    )
    return named.select("site", text.alias("robots_txt"))


def letters(spark: SparkSession, d: str) -> DataFrame:
    """Dead letters made of the event log; the payload's form follows from the event type."""
    e = events(spark, d)
    job = F.col("k").cast("string")
    uid = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    url = F.concat(F.lit("http://h.example.com/"), F.col("k").cast("string"))
    base = [job.alias("job_id"), url.alias("url"), url.alias("normalized_url")]
    page = [F.lit("key").alias("storage_key"), F.lit("sum").alias("checksum"), F.array().cast("array<string>").alias("extracted_links")]
    payload = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct(uid.alias("event_id"), *base, *page)))
        .when(F.col("event_type") == "view", F.to_json(F.struct(uid.alias("event_id"), *base)))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(*base)))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(uid.alias("event_id"), *page)))
        .otherwise(F.to_json(F.struct(uid.alias("event_id"), F.lit("x").alias("note"))))
    )
    return e.select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("error"), payload.alias("payload"))


def failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed fetches: every event as a failure with an attempt number and a stage."""
    e = events(spark, d)
    stage = F.when(F.col("event_type") == "click", "cleaner").when(F.col("event_type") == "view", "parser").otherwise("crawler")
    return e.select(
        "event_id", F.col("ts").alias("timestamp"), (F.col("k") % 7 + 1).alias("attempt"), stage.alias("stage"),
        F.concat(F.lit("HTTP "), (F.lit(400) + F.col("k")).cast("string")).alias("error"),
        F.when((F.col("event_type") == "click") & (F.col("k") % 2 == 0), F.col("props")).alias("page_payload"),
        (F.col("k") % 3 == 0).alias("force_recrawl"),
    )
