"""Corpus jobs: canonical URL tables, page records, link edges, cleaned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import html as H
from crawlframe.functions import jsondoc as J
from crawlframe.functions.lang import ordered_distinct, reusable, unnest
from crawlframe.functions.text import collapse
from crawlframe.functions.urls import domain_of, host_suffixes, normalize_url, url_key
from crawlframe.schemas import MAX_LENGTHS
from crawlframe.session import small_or_shuffled


def canonicalize(df: DataFrame, url: str = "url") -> DataFrame:
    """Add normalized_url, url_key and domain."""
    return (
        df.withColumn("normalized_url", normalize_url(url))
        .withColumn("url_key", url_key(F.col("normalized_url")))
        .withColumn("domain", domain_of(F.col("normalized_url")))
    )


@reusable
def _page_columns(url: str, html: str) -> tuple[dict, dict, dict, dict]:
    """Expressions of a page record in stages; a later stage reads the columns of the earlier ones."""
    m, base = F.col("_markup"), F.col(url)
    return (
        {"_markup": H.visible_markup(F.col(html))},
        {"_meta": H.meta_records(m), "_ld": H.json_ld(F.col(html)), "_rel": H.rel_links(m, base)},
        {"_og": H.open_graph(F.col("_meta")), "_plain": H.meta_tags(F.col("_meta"))},
        {
            "title": H.title(m),
            "description": H.description(F.col("_meta")),
            "language": H.language(m),
            "text_snippet": H.snippet(m),
            "extracted_links": H.page_links(m, base),
            "open_graph": F.col("_og"),
            "meta_tags": F.col("_plain"),
            "json_ld": F.transform("_ld", lambda v: F.to_json(v)),
            "schema_types": H.schema_types(F.col("_ld")),
            "metadata": H.flat_metadata(F.col("_og"), F.col("_plain")),
            "next_url": F.get("_rel", F.lit(0)),
            "prev_url": F.get("_rel", F.lit(1)),
            "page_numbers": H.page_numbers(m),
            "is_infinite_scroll": H.infinite_scroll(m),
            "content_type": F.lit("text/html"),
        },
    )


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """HTML corpus -> page records, in one projection; unused fields are pruned by the reader."""
    kept = [c for c in pages.columns if c != html]
    markup, parsed, maps, fields = _page_columns(url, html)
    staged = pages.withColumns(markup).withColumns(parsed).withColumns(maps)
    return staged.select(*kept, *[c.alias(n) for n, c in fields.items()])


def extract_json(docs: DataFrame, body: str = "html") -> DataFrame:
    """JSON corpus -> page records of the same columns."""
    kept = [c for c in docs.columns if c not in (body, "content_type")]
    doc = F.col("_doc")
    empty = F.create_map().cast("map<string,string>")
    source = F.create_map(F.lit("source"), F.lit("json"))
    return docs.withColumn("_doc", F.try_parse_json(F.col(body))).select(
        *kept,
        J.document_title(doc).alias("title"),
        J.document_description(doc).alias("description"),
        F.lit(None).cast("string").alias("language"),
        J.document_snippet(F.col(body)).alias("text_snippet"),
        J.document_links(doc).alias("extracted_links"),
        empty.alias("open_graph"),
        source.alias("meta_tags"),
        F.array().cast("array<string>").alias("json_ld"),
        F.array().cast("array<string>").alias("schema_types"),
        source.alias("metadata"),
        F.lit(None).cast("string").alias("next_url"),
        F.lit(None).cast("string").alias("prev_url"),
        F.array().cast("array<string>").alias("page_numbers"),
        F.lit(False).alias("is_infinite_scroll"),
        F.lit("application/json").alias("content_type"),
    )


def extract_any(docs: DataFrame, url: str = "url", body: str = "html") -> tuple[DataFrame, DataFrame]:
    """Mixed corpus with a content_type column -> (page records, unreadable JSON bodies)."""
    is_json = F.contains(F.lower(F.coalesce("content_type", F.lit("text/html"))), F.lit("json"))
    readable = F.try_parse_json(F.col(body)).isNotNull()
    records = extract_pages(docs.filter(~is_json).drop("content_type"), url, body).unionByName(
        extract_json(docs.filter(is_json & readable), body)
    )
    return records, docs.filter(is_json & ~readable)


def clean_pages(records: DataFrame) -> DataFrame:
    """Storable page rows: white space collapsed, lengths cut, links distinct."""
    return records.withColumns(
        {
            "title": collapse(F.col("title"), 1024),
            "description": collapse(F.col("description")),
            "text_snippet": collapse(F.col("text_snippet"), 500),
            "extracted_links": ordered_distinct(F.col("extracted_links")),
        }
    )


def length_problem(df: DataFrame) -> Column:
    """Name of the first column longer than its limit, null if none is."""
    tests = [
        F.when(F.length(F.col(n)) > limit, F.lit(f"{n} too long"))
        for n, limit in MAX_LENGTHS.items() if n in df.columns
    ]
    return F.coalesce(*tests)


def split_by_length(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows within the column limits, rows that fail with an error)."""
    checked = df.withColumn("error", length_problem(df))
    return (
        checked.filter(F.col("error").isNull()).drop("error"),
        checked.filter(F.col("error").isNotNull()),
    )


@reusable
def _links(url: str, html: str) -> Column:
    return H.page_links(H.visible_markup(F.col(html)), F.col(url))


def link_edges(pages: DataFrame, source: str = "normalized_url", url: str = "url", html: str = "html") -> DataFrame:
    """Link graph: one (src, dst, pos) row per canonical link of a page."""
    edges = unnest(pages, _links(url, html), "pos", "dst", keep=[F.col(source).alias("src")])
    return edges.select("src", "dst", "pos")


def in_domains(df: DataFrame, host: str, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows whose host equals or is below a listed domain.

    Distinct hosts are matched through their suffixes by an equi-join, then kept rows by host.
    """
    wanted = domains.select(F.col(domain).alias("_suffix")).distinct()
    hosts = df.select(F.col(host).alias("_host")).distinct()
    passed = (
        hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("_suffix"))
        .join(wanted, "_suffix", "left_semi").select("_host").distinct()
    )
    return df.join(passed, F.col(host) == F.col("_host"), "left_semi")


def in_exact_domains(df: DataFrame, host: str, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows whose host is listed."""
    wanted = small_or_shuffled(domains.select(F.col(domain).alias("_host")).distinct())
    return df.join(wanted, F.col(host) == F.col("_host"), "left_semi")
