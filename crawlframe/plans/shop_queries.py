"""Parts as shop pages and JSON documents whose metadata, links and pagination come from the table, with their SQL checks.

The markup varies by part: descriptions that are empty or only in the graph, repeated keys, linked data as object, list, broken text or
no object, relative and entity-coded targets, numbered anchors, both marks of endless pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.functions.urls import domain_of
from crawlframe.operators import corpus, merge
from crawlframe.operators import search as R
from crawlframe.plans.bindings import flat
from crawlframe.session import spread
from crawlframe.sources.tables import read_table

SITE = "https://shop.example.com/parts/"
_CASE = "element_at(array({}), cast(p_partkey % {} as int) + 1)"


def _pick(*choices: str):
    """One of some SQL texts, by the part's number."""
    return F.expr(_CASE.format(", ".join(choices), len(choices)))


def _parts(spark, d):
    p = spread(read_table(spark, d, "part"))
    return p.withColumns({"k": F.col("p_partkey").cast("string"), "size": F.col("p_size").cast("string"),
                          "url": F.concat(F.lit(SITE), F.col("p_partkey").cast("string"))})


def shop_pages(spark, d):
    """(url_id, url, normalized_url, html) of every part."""
    ld = lambda body: f"concat('<script type=\"application/ld+json\">', {body}, '</script>')"
    html = F.concat(
        F.lit('<html lang="'), _pick("'en'", "'fr'", "'de'"), F.lit('"><head><title>'), F.col("p_brand"), F.lit(" "), F.col("k"), F.lit("</title>"),
        _pick("concat('<meta name=\"description\" content=\" ', p_type, ' \">')",
              "concat('<meta name=\"Description\" content=\"\"><meta property=\"og:description\" content=\"OG ', p_brand, '\">')",
              "concat('<META content=''Only ', p_brand, ''' property=og:description>')", "''"),
        F.lit('<meta property="og:title" content="'), F.col("p_brand"), F.lit('">'),
        _pick("concat('<meta property=\"og:title\" content=\"', p_type, '\">')", "''", "''", "''", "''"),
        F.lit('<meta name="keywords" content="'), F.col("p_type"), F.lit('">'),
        _pick("concat('<meta name=\"keywords\" content=\"size ', size, '\">')", "''", "''"),
        _pick("'<meta name=\"og:title\" content=\"plain\">'", "''", "''", "''", "''", "''", "''"),
        _pick(ld("'{\"@type\":\"Product\",\"name\":\"x\"}'"), ld("'[{\"@type\":\"Offer\"},{\"@type\":[\"Thing\",\"Product\"]},5]'"), ld("'{bad'"), ld("'\"text\"'"),
              f"concat({ld(chr(39) + '{\"@type\":\"Product\"}' + chr(39))}, {ld(chr(39) + '[{\"@type\":\"Brand\"},{\"@type\":\"Product\"}]' + chr(39))})", "''"),
        _pick("concat('<link rel=\"next\" href=\"/parts/', p_partkey + 1, '?b=2&amp;a=1\">')", "''", "''"),
        _pick("concat('<link href=''../parts/', p_partkey - 1, '/'' rel=''prev nofollow''>')", "''"),
        F.lit("</head><body>"), _pick("''", "'<div data-infinite-scroll=\"true\">'", "'<div class=\"list infinite_scroll x\">'", "'<div class=infinitely>'", "'<p>'"),
        F.lit('<a href="?page=1">'), F.col("size"), F.lit('</a> <a href="?page=2"> '), (F.col("p_size") + 1).cast("string"),
        F.lit(' </a><a href="/z">007</a><a href="/next">next</a><a name="no">99</a>'), F.when(F.col("p_size") % 2 == 1, "<a href=x><b>12</b></a>").otherwise(""),
    )
    return _parts(spark, d).select("p_partkey", "p_size", F.col("p_partkey").alias("url_id"), "url", F.col("url").alias("normalized_url"), html.alias("html"))


def _pairs(col: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


def shop_metadata(spark, d):
    p = corpus.extract_pages(shop_pages(spark, d))
    return p.select("url_id", "language", "title", "description", _pairs("open_graph").alias("open_graph"), _pairs("meta_tags").alias("meta_tags"), _pairs("metadata").alias("metadata"))


def shop_linked_data(spark, d):
    p = corpus.extract_pages(shop_pages(spark, d))
    return flat(p.select("url_id", F.size("json_ld").alias("objects"), F.array_join("schema_types", ",").alias("types")))


def shop_navigation(spark, d):
    p = corpus.extract_pages(shop_pages(spark, d))
    return p.select("url_id", "next_url", "prev_url", F.array_join("page_numbers", ",").alias("page_numbers"), "is_infinite_scroll")


def shop_upsert(spark, d):
    """All content columns merged into a table that holds the pages of large parts; pages of small sizes come twice."""
    p = corpus.clean_pages(corpus.extract_pages(shop_pages(spark, d))).withColumns({
        "seq": F.lit(1), "url_id": F.col("url_id").cast("string"), "id": F.concat(F.lit("new"), F.col("url_id").cast("string"))})
    again = p.where(F.col("p_size") < 20).withColumns({"seq": F.lit(2), "title": F.lit("second"), "description": F.lit(None).cast("string"),
                                                      "id": F.lit("later")})
    cols = ["url_id", "id", "title", "description", "language", "text_snippet", "extracted_links", "metadata"]
    old = p.where(F.col("p_size") > 10).select(*[F.lit("old").alias(c) if c in ("id", "title", "language") else F.col(c) for c in cols])
    out = merge.upsert_pages(old, p.unionByName(again), ["seq"])
    return flat(out.select("url_id", "id", "title", "description", "language", "text_snippet", F.array_join("extracted_links", " ").alias("links"), _pairs("metadata").alias("metadata")))


def shop_page_lookup(spark, d):
    """One stored page in all columns of the page view."""
    p = corpus.clean_pages(corpus.extract_pages(shop_pages(spark, d)))
    urls = shop_pages(spark, d).select(F.col("url_id").alias("id"), F.col("url").alias("canonical_url"), "normalized_url", domain_of(F.col("normalized_url")).alias("domain"))
    page = R.page_by_url_id(p.drop("url", "normalized_url"), urls, 42)
    return page.select("url_id", "url", "normalized_url", "domain", "title", "description", "language", "text_snippet",
                       F.array_join("extracted_links", " ").alias("links"), _pairs("metadata").alias("metadata"))


def _documents(spark, d):
    """Every third part as a page, the others as JSON in four forms, some of them cut off."""
    body = _pick(
        "concat('{\"title\":\"', p_brand, '\",\"description\":\"', p_type, '\",\"url\":\"https://a/', k, '\",\"items\":[{\"url\":\"http://i/1\"},{\"link\":\"/rel\"},{\"href\":\"http://i/', size, '\"}]}')",
        "concat('{\"name\":\"', p_type, '\",\"results\":[{\"link\":\"http://r/', k, '\"},3],\"next\":\"https://n/', p_partkey + 1, '\"}')",
        "concat('[{\"url\":\"http://l/', k, '\"},{\"url\":\"http://l/', k, '\"},{\"url\":7}]')", "'{}'")
    cut = F.when(F.col("p_partkey") % 16 == 4, F.substring(body, 1, 12)).otherwise(body)
    kind = F.col("p_partkey") % 3
    page = F.concat(F.lit("<title>"), F.col("k"), F.lit("</title><a href=/q>x</a>"))
    return _parts(spark, d).select("p_partkey", "url", F.when(kind == 2, page).otherwise(cut).alias("html"),
                                   F.when(kind == 2, F.lit(None)).when(kind == 1, "application/JSON").otherwise("text/json; charset=utf-8").alias("content_type"))


def shop_json(spark, d):
    records, _ = corpus.extract_any(_documents(spark, d))
    return records.select("p_partkey", "content_type", "title", "description", F.array_join("extracted_links", " ").alias("links"), "text_snippet", _pairs("metadata").alias("metadata"))


def shop_unreadable(spark, d):
    _, broken = corpus.extract_any(_documents(spark, d))
    return broken.select("p_partkey", F.col("html").alias("body"))


QUERIES = {f.__name__: f for f in (shop_metadata, shop_linked_data, shop_navigation, shop_upsert, shop_page_lookup, shop_json, shop_unreadable)}

_P = f"""p AS (SELECT p_partkey AS url_id, '{SITE}' || p_partkey AS url, p_brand || ' ' || p_partkey AS title, ['en', 'fr', 'de'][p_partkey % 3 + 1] AS language, *,
  [p_type, 'OG ' || p_brand, 'Only ' || p_brand, NULL][p_partkey % 4 + 1] AS description,
  CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END AS og_title, CASE WHEN p_partkey % 3 = 0 THEN 'size ' || p_size ELSE p_type END AS keywords FROM part),
m AS (SELECT *, concat_ws('|', CASE WHEN p_partkey % 4 IN (1, 2) THEN 'og:description=' || description END, 'og:title=' || og_title) AS open_graph,
  concat_ws('|', CASE WHEN p_partkey % 4 = 0 THEN 'description=' || description END, 'keywords=' || keywords, CASE WHEN p_partkey % 7 = 0 THEN 'og:title=plain' END) AS meta_tags,
  concat_ws('|', CASE WHEN p_partkey % 4 = 0 THEN 'description=' || description END, 'keywords=' || keywords, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'og:description=' || description END,
    'og:title=' || CASE WHEN p_partkey % 7 = 0 THEN 'plain' ELSE og_title END) AS metadata,
  concat_ws(' ', title, p_size, p_size + 1, '007 next 99', CASE WHEN p_size % 2 = 1 THEN '12' END) AS text_snippet,
  concat_ws(' ', url || '?page=1', url || '?page=2', 'https://shop.example.com/z', 'https://shop.example.com/next', CASE WHEN p_size % 2 = 1 THEN '{SITE}x' END) AS links FROM p)"""

_J = """j AS (SELECT p_partkey, p_partkey % 3 AS kind, p_partkey % 4 AS form, p_brand, p_type, p_size, [
  '{"title":"' || p_brand || '","description":"' || p_type || '","url":"https://a/' || p_partkey || '","items":[{"url":"http://i/1"},{"link":"/rel"},{"href":"http://i/' || p_size || '"}]}',
  '{"name":"' || p_type || '","results":[{"link":"http://r/' || p_partkey || '"},3],"next":"https://n/' || p_partkey + 1 || '"}',
  '[{"url":"http://l/' || p_partkey || '"},{"url":"http://l/' || p_partkey || '"},{"url":7}]', '{}'][p_partkey % 4 + 1] AS body FROM part)"""

ORACLE = {
    "shop_metadata": f"WITH {_P} SELECT url_id, language, title, description, open_graph, meta_tags, metadata FROM m",
    "shop_linked_data": """SELECT p_partkey AS url_id, [1, 2, 0, 0, 3, 0][p_partkey % 6 + 1]::BIGINT AS objects,
      ['Product', 'Offer,Thing,Product', '', '', 'Product,Brand', ''][p_partkey % 6 + 1] AS types FROM part""",
    "shop_navigation": f"""SELECT p_partkey AS url_id, CASE WHEN p_partkey % 3 = 0 THEN '{SITE}' || p_partkey + 1 || '?a=1&b=2' END AS next_url,
      CASE WHEN p_partkey % 2 = 0 THEN '{SITE}' || p_partkey - 1 END AS prev_url,
      array_to_string(list_sort(list_distinct([p_size, p_size + 1, 7, CASE WHEN p_size % 2 = 1 THEN 12 ELSE 7 END])), ',') AS page_numbers,
      p_partkey % 5 IN (1, 2) AS is_infinite_scroll FROM part""",
    "shop_upsert": f"""WITH {_P} SELECT url_id::VARCHAR AS url_id, CASE WHEN p_size > 10 THEN 'old' ELSE 'new' || url_id END AS id, CASE WHEN p_size < 20 THEN 'second' ELSE title END AS title,
      CASE WHEN p_size >= 20 THEN description END AS description, language, text_snippet, links, metadata FROM m""",
    "shop_page_lookup": f"""WITH {_P} SELECT url_id, url, url AS normalized_url, 'shop.example.com' AS domain, title, description, language, text_snippet, links, metadata FROM m WHERE url_id = 42""",
    "shop_json": f"""WITH {_J} SELECT p_partkey, CASE kind WHEN 2 THEN 'text/html' ELSE 'application/json' END AS content_type,
      CASE WHEN kind = 2 THEN p_partkey::VARCHAR WHEN form = 0 THEN p_brand WHEN form = 1 THEN p_type END AS title, CASE WHEN kind <> 2 AND form = 0 THEN p_type END AS description,
      CASE WHEN kind = 2 THEN 'https://shop.example.com/q' ELSE ['https://a/' || p_partkey || ' http://i/1' || CASE WHEN p_size <> 1 THEN ' http://i/' || p_size ELSE '' END,
        'https://n/' || p_partkey + 1 || ' http://r/' || p_partkey, 'http://l/' || p_partkey, ''][form + 1] END AS links,
      CASE WHEN kind = 2 THEN p_partkey || ' x' WHEN form <> 3 THEN body END AS text_snippet, CASE WHEN kind = 2 THEN '' ELSE 'source=json' END AS metadata
      FROM j WHERE kind = 2 OR p_partkey % 16 <> 4""",
    "shop_unreadable": f"WITH {_J} SELECT p_partkey, substr(body, 1, 12) AS body FROM j WHERE kind <> 2 AND p_partkey % 16 = 4",
}
