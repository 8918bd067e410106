"""URL, extraction and cleaning queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.functions import html as H
from crawlframe.functions import text as X
from crawlframe.functions import urls as U
from crawlframe.functions.lang import unnest
from crawlframe.operators import corpus
from crawlframe.operators.accounting import top_domains
from crawlframe.operators.dedup import earliest
from crawlframe.plans import bindings as B
from crawlframe.plans import sql_text as S
from crawlframe.plans.bindings import flat
from crawlframe.sources.tables import artifacts

DOMAINS = ["example.com", "www.example.org", "blog.example.net"]
DOMAIN_LIST = "['example.com', 'www.example.org', 'blog.example.net']"


def url_normalize(spark, d):
    return B.pages(spark, d).select("page_id", U.normalize_url("url").alias("normalized_url"))


def url_key_dedup(spark, d):
    named = corpus.canonicalize(B.pages(spark, d).select("page_id", "url"))
    return flat(earliest(named, ["url_key"], ["page_id"]).select("page_id", "url_key"))


def domain_of(spark, d):
    p = corpus.canonicalize(B.pages(spark, d).select("page_id", "url"))
    return p.select("page_id", "domain")


def link_allowlist_array(spark, d):
    pages = corpus.extract_pages(B.pages(spark, d)).select("page_id", "extracted_links")
    kept = U.keep_allowed(F.col("extracted_links"), F.array(*[F.lit(x) for x in DOMAINS]))
    return flat(pages.select("page_id", F.size(kept).alias("kept"), F.size("extracted_links").alias("links")))


def link_allowlist_semi(spark, d):
    edges = corpus.link_edges(B.pages(spark, d), source="page_id").withColumn("host", U.domain_of(F.col("dst")))
    done = B.read_table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page_id"))
    wanted = B.pages(spark, d).join(done, "page_id", "left_semi").select(
        F.regexp_extract(U.domain_of(U.normalize_url("url")), r"^[^.]+\.(.*)$", 1).alias("domain")
    )
    return flat(corpus.in_domains(edges, "host", wanted).select(F.col("src").alias("page_id"), "dst"))


_RELATIVE = ["../a/./b", "?x=1", "//cdn.example.org/lib", "sub/page", "./", "..", "../../../top", "/abs/../c", "#frag", ""]


def link_resolve(spark, d):
    hrefs = F.array(*[F.concat(F.lit(h), F.when(F.lit(h).isin("sub/page", "../a/./b"), F.col("page_id").cast("string")).otherwise("")) for h in _RELATIVE])
    resolved = B.pages(spark, d).select("page_id", F.posexplode(U.resolve_urls(F.col("url"), hrefs)).alias("pos", "target"))
    return flat(resolved)


def href_filter(spark, d):
    kept = F.filter(H.anchor_hrefs(H.visible_markup(F.col("html"))), U.navigable)
    return B.pages(spark, d).select("page_id", F.array_join(kept, "\n").alias("hrefs"))


def site_robots_urls(spark, d):
    p = B.pages(spark, d).select(U.normalize_url("url").alias("u"))
    return p.select(U.robots_url(F.col("u")).alias("robots_url"), U.sitemap_url(F.col("u")).alias("sitemap_url")).distinct()


def html_artifacts(spark, d):
    p = B.pages(spark, d).withColumn("normalized_url", U.normalize_url("url"))
    return flat(artifacts(p, F.lit("job-1")).select("page_id", "storage_key", "checksum", "size_bytes"))


def extract_title_lang(spark, d):
    return corpus.extract_pages(B.pages(spark, d)).select("page_id", "title", "language")


def extract_snippet(spark, d):
    return corpus.extract_pages(B.pages(spark, d)).select("page_id", "text_snippet")


def extract_text(spark, d):
    return B.pages(spark, d).select("page_id", F.sha2(H.text_content(H.visible_markup(F.col("html"))), 256).alias("text_hash"))


def extract_links(spark, d):
    p = corpus.extract_pages(B.pages(spark, d))
    return flat(unnest(p, F.col("extracted_links"), "pos", "link", keep=["page_id"]))


def extract_page_numbers(spark, d):
    return corpus.extract_pages(B.pages(spark, d)).select("page_id", F.array_join("page_numbers", ",").alias("page_numbers"))


def extract_infinite_scroll(spark, d):
    return corpus.extract_pages(B.pages(spark, d)).select("page_id", "is_infinite_scroll")


def extract_metadata(spark, d):
    p = corpus.extract_pages(B.pages(spark, d))
    return flat(p.select(
        "page_id", "description", F.size("metadata").alias("meta_count"), F.size("json_ld").alias("json_ld_count"),
        F.size("schema_types").alias("type_count"), "next_url", "prev_url",
    ))


def page_index(spark, d):
    p = corpus.clean_pages(corpus.extract_pages(B.pages(spark, d)))
    return flat(p.select(
        "page_id", U.normalize_url("url").alias("normalized_url"), "title", "language", "text_snippet",
        F.size("extracted_links").alias("link_count"), F.array_join("extracted_links", " ").alias("links"),
    ))


def link_edges(spark, d):
    p = B.pages(spark, d).withColumn("normalized_url", U.normalize_url("url"))
    return flat(corpus.link_edges(p))


def link_indegree_by_domain(spark, d):
    edges = corpus.link_edges(B.pages(spark, d), source="page_id")
    hosts = edges.select(U.domain_of(F.col("dst")).alias("domain"))
    return top_domains(hosts)


def clean_text(spark, d):
    docs = B.documents(spark, d)
    return docs.select("doc_id", X.collapse(F.col("text"), 1024).alias("title"), F.sha2(X.collapse(F.col("text")), 256).alias("clean_hash"))


def length_violations(spark, d):
    docs = B.documents(spark, d).select(
        "doc_id", F.col("text").alias("title"), F.col("source").alias("domain"),
        F.concat(F.lit("http://h/"), F.col("text")).alias("normalized_url"), F.col("lang").alias("language"),
    )
    ok, bad = corpus.split_by_length(docs)
    return ok.select("doc_id", F.lit("ok").alias("verdict")).unionByName(bad.select("doc_id", F.col("error").alias("verdict")))


QUERIES = {f.__name__: f for f in (
    url_normalize, url_key_dedup, domain_of, link_allowlist_array, link_allowlist_semi, link_resolve, href_filter,
    site_robots_urls, html_artifacts, extract_title_lang, extract_snippet, extract_text, extract_links,
    extract_page_numbers, extract_infinite_scroll, extract_metadata, page_index, link_edges, link_indegree_by_domain,
    clean_text, length_violations,
)}

_PC = S.canonical("pc", "pages", "url")
_NUMBERS = r"""list_sort(list_distinct(list_transform(list_filter(list_transform(
  regexp_extract_all(m, '(?is)<a\s[^>]*href[^>]*>.*?</a\s*>'), lambda x: regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', '', 'g')),
  lambda x: regexp_matches(x, '^[0-9]+$')), lambda x: x::BIGINT)))"""
_REL = ", ".join(
    f"'{h}'" + (" || page_id" if h in ("sub/page", "../a/./b") else "") for h in _RELATIVE
)
_RESOLVE = f"""
WITH h AS (SELECT page_id, url, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS href FROM (SELECT page_id, url, [{_REL}] AS hs FROM pages)),
p AS (SELECT *, {S.parts('url')} AS b, {S.parts('href')} AS r FROM h),
s AS (SELECT *, CASE WHEN starts_with(r.p, '/') THEN string_split(r.p, '/')
  ELSE list_concat(string_split(regexp_replace(b.p, '/[^/]*$', ''), '/'), string_split(r.p, '/')) END AS segs FROM p),
f AS (SELECT *, list_reduce(list_concat([[]::VARCHAR[]], list_transform(segs, lambda x: [x])),
  lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, x) END) AS kept FROM s),
g AS (SELECT *, array_to_string(CASE WHEN segs[-1] IN ('.', '..') THEN list_concat(kept, ['']) ELSE kept END, '/') AS path FROM f)
SELECT page_id, pos, CASE WHEN r.n <> '' THEN b.s || '://' || r.n || r.p
  WHEN r.p = '' THEN b.s || '://' || b.n || b.p || CASE WHEN r.q <> '' THEN '?' || r.q WHEN b.q <> '' THEN '?' || b.q ELSE '' END
  ELSE b.s || '://' || b.n || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END || CASE WHEN r.q <> '' THEN '?' || r.q ELSE '' END END AS target
FROM g"""

ORACLE = {
    "url_normalize": f"WITH {_PC} SELECT page_id, nu AS normalized_url FROM pc",
    "url_key_dedup": f"WITH {_PC} SELECT min(page_id) AS page_id, sha256(nu) AS url_key FROM pc GROUP BY nu",
    "domain_of": f"WITH {_PC} SELECT page_id, {S.host('nu')} AS domain FROM pc",
    "link_allowlist_array": f"""WITH {S.LINKS} SELECT page_id, count(*) FILTER (len(list_filter({DOMAIN_LIST},
      lambda a: {S.host('dst')} = a OR ends_with({S.host('dst')}, '.' || a))) > 0) AS kept, count(*) AS links FROM links GROUP BY page_id""",
    "link_allowlist_semi": rf"""WITH {S.LINKS}, {_PC},
      w2 AS (SELECT DISTINCT regexp_extract({S.host('nu')}, '^[^.]+\.(.*)$', 1) AS domain FROM pc JOIN orders ON o_orderkey = page_id WHERE o_orderstatus = 'F')
      SELECT page_id, dst FROM links WHERE EXISTS (SELECT 1 FROM w2 WHERE {S.host('dst')} = domain OR ends_with({S.host('dst')}, '.' || domain))""",
    "link_resolve": _RESOLVE,
    "href_filter": f"WITH {S.markup()} SELECT page_id, array_to_string({S.HREFS}, chr(10)) AS hrefs FROM mk",
    "site_robots_urls": rf"""WITH {_PC} SELECT DISTINCT regexp_extract(nu, '^[a-z]+://[^/?#]*') || '/robots.txt' AS robots_url,
      regexp_extract(nu, '^[a-z]+://[^/?#]*') || '/sitemap.xml' AS sitemap_url FROM pc""",
    "html_artifacts": f"""WITH {_PC} SELECT page_id, 'job-1/' || sha256(nu) || '.html' AS storage_key, sha256(html) AS checksum,
      octet_length(encode(html))::BIGINT AS size_bytes FROM pc""",
    "extract_title_lang": f"WITH {S.markup()} SELECT page_id, {S.TITLE} AS title, {S.LANGUAGE} AS language FROM mk",
    "extract_snippet": f"WITH {S.markup()} SELECT page_id, {S.SNIPPET} AS text_snippet FROM mk",
    "extract_text": f"WITH {S.markup()} SELECT page_id, sha256({S.TEXT}) AS text_hash FROM mk",
    "extract_links": f"WITH {S.LINKS} SELECT page_id, pos, dst AS link FROM links",
    "extract_page_numbers": f"WITH {S.markup()} SELECT page_id, array_to_string({_NUMBERS}, ',') AS page_numbers FROM mk",
    "extract_infinite_scroll": rf"""WITH {S.markup()} SELECT page_id, regexp_matches(m, '(?is)<[a-z][^>]*\sdata-infinite-scroll[\s=/>]')
      OR regexp_matches(m, '(?is)<[a-z][^>]*\sclass\s*=\s*"[^"]*infinite[-_]?scroll') AS is_infinite_scroll FROM mk""",
    "extract_metadata": r"""SELECT page_id,
      nullif(regexp_extract(html, '(?is)<meta\s+name="description"\s+content="([^"]*)"', 1), '') AS description,
      len(regexp_extract_all(html, '(?is)<meta\s[^>]*(?:property="og:|name=")')) AS meta_count,
      len(regexp_extract_all(html, '(?is)<script[^>]*ld\+json')) AS json_ld_count,
      len(regexp_extract_all(html, '"@type"')) AS type_count,
      nullif(regexp_extract(html, '(?is)<link[^>]*rel="next"[^>]*href="([^"]*)"', 1), '') AS next_url,
      nullif(regexp_extract(html, '(?is)<link[^>]*rel="prev"[^>]*href="([^"]*)"', 1), '') AS prev_url FROM pages""",
    "page_index": f"""WITH {S.LINKS}, {_PC}, li AS (SELECT page_id, count(*) AS n, string_agg(dst, ' ' ORDER BY pos) AS l FROM links GROUP BY page_id)
      SELECT mk.page_id, nu AS normalized_url, {S.collapse(S.TITLE, 1024)} AS title, {S.LANGUAGE} AS language,
      {S.collapse(S.SNIPPET, 500)} AS text_snippet, coalesce(n, 0) AS link_count, coalesce(l, '') AS links
      FROM mk JOIN pc USING (page_id) LEFT JOIN li USING (page_id)""",
    "link_edges": f"WITH {S.LINKS}, {_PC} SELECT nu AS src, dst, pos FROM links JOIN pc USING (page_id)",
    "link_indegree_by_domain": f"""WITH {S.LINKS} SELECT {S.host('dst')} AS domain, count(*) AS urls FROM links
      GROUP BY 1 ORDER BY urls DESC, domain LIMIT 20""",
    "clean_text": f"SELECT doc_id, {S.collapse('text', 1024)} AS title, sha256({S.collapse('text', 10000)}) AS clean_hash FROM documents",
    "length_violations": """SELECT doc_id, CASE WHEN length('http://h/' || text) > 2048 THEN 'normalized_url too long'
      WHEN length(source) > 255 THEN 'domain too long' WHEN length(text) > 1024 THEN 'title too long'
      WHEN length(lang) > 16 THEN 'language too long' ELSE 'ok' END AS verdict FROM documents""",
}
