"""Trigram search queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.operators import search as R
from crawlframe.operators.corpus import clean_pages, extract_pages
from crawlframe.plans import bindings as B
from crawlframe.plans import sql_text as S
from crawlframe.plans.bindings import flat
from crawlframe.sources.tables import read_table

PHRASE = "the other than, tion les que"


def _index(spark, d):
    return clean_pages(extract_pages(B.pages(spark, d))).withColumnRenamed("page_id", "url_id")


def search_topk(spark, d):
    hits, _ = R.search_pages(_index(spark, d), B.urls(spark, d), PHRASE, limit=50, offset=5)
    return hits.select("title", "url", "normalized_url", "description", "text_snippet", "domain", F.round("score", 6).alias("score"))


def search_total(spark, d):
    return R.search_pages(_index(spark, d), B.urls(spark, d), PHRASE)[1]


def search_page_lookup(spark, d):
    page = R.page_by_url_id(_index(spark, d), B.urls(spark, d), 42)
    return page.select("url_id", "title", "url", "normalized_url", "text_snippet", "domain", "language")


def search_documents(spark, d):
    """Similarity of every whole document to one phrase."""
    docs = B.documents(spark, d).select("doc_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("text_snippet"))
    return R.score_pages(docs, PHRASE, 0.02).select("doc_id", F.round("score", 6).alias("score"))


def trigram_postings(spark, d):
    posts = R.postings(B.documents(spark, d), "doc_id", "text")
    return posts.groupBy("trigram").agg(F.count("*").alias("docs"), F.sum("n").cast("bigint").alias("sizes"))


def _batch(spark, d):
    return R.similarity_join(B.documents(spark, d), "doc_id", "text", read_table(spark, d, "benchmark"), "item_id", "text")


def search_batch_topk(spark, d):
    best = R.best_per_query(_batch(spark, d), "item_id", "doc_id", 10)
    return flat(best.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank"))


def search_batch_matches(spark, d):
    return _batch(spark, d).groupBy("item_id").agg(F.count("*").alias("matches"), F.round(F.sum("score"), 4).alias("score_sum"))


QUERIES = {f.__name__: f for f in (
    search_topk, search_total, search_page_lookup, search_documents, trigram_postings, search_batch_topk, search_batch_matches,
)}

_IDX = S.URLS + "," + S.markup() + f""",
idx AS (SELECT page_id AS url_id, {S.collapse(S.TITLE, 1024)} AS title, {S.LANGUAGE} AS language, {S.collapse(S.SNIPPET, 500)} AS text_snippet FROM mk),
q AS (SELECT {S.trigrams(f"'{PHRASE}'")} AS g),
tg AS (SELECT *, {S.trigrams('title')} AS tt, {S.trigrams('text_snippet')} AS ts FROM idx),
sc AS (SELECT tg.*, {S.similarity('tt', 'q.g')} AS st, {S.similarity('ts', 'q.g')} AS ss FROM tg, q),
hits AS (SELECT sc.*, greatest(coalesce(st, 0), coalesce(ss, 0)) AS score, canonical_url, normalized_url, domain FROM sc JOIN urls ON url_id = id
  WHERE (title IS NOT NULL AND st >= 0.1) OR (text_snippet IS NOT NULL AND ss >= 0.1))"""
_PAIRS = f"""
dg AS MATERIALIZED (SELECT doc_id, {S.trigrams('text')} AS g FROM documents), qg AS MATERIALIZED (SELECT item_id, {S.trigrams('text')} AS g FROM benchmark),
dp AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM dg), qp AS (SELECT item_id, len(g) AS n, unnest(g) AS t FROM qg),
pairs AS (SELECT item_id, doc_id, count(*) AS s, max(dp.n) AS dn, max(qp.n) AS qn FROM qp JOIN dp USING (t) GROUP BY 1, 2),
scored AS (SELECT item_id, doc_id, s / (dn + qn - s) AS score FROM pairs WHERE s / (dn + qn - s) >= 0.1)"""

ORACLE = {
    "search_topk": f"""WITH {_IDX} SELECT title, canonical_url AS url, normalized_url, NULL::VARCHAR AS description, text_snippet, domain, round(score, 6) AS score
      FROM hits ORDER BY hits.score DESC, normalized_url LIMIT 50 OFFSET 5""",
    "search_total": f"WITH {_IDX} SELECT count(*) AS total FROM hits",
    "search_page_lookup": f"""WITH {_IDX} SELECT url_id, title, canonical_url AS url, normalized_url, text_snippet, domain, language
      FROM idx JOIN urls ON id = url_id WHERE url_id = 42""",
    "search_documents": f"""WITH q AS (SELECT {S.trigrams(f"'{PHRASE}'")} AS g), dg AS (SELECT doc_id, {S.trigrams('text')} AS g FROM documents),
      sc AS (SELECT doc_id, {S.similarity('dg.g', 'q.g')} AS score FROM dg, q) SELECT doc_id, round(score, 6) AS score FROM sc WHERE score >= 0.02""",
    "trigram_postings": f"""WITH dg AS (SELECT doc_id, {S.trigrams('text')} AS g FROM documents), dp AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM dg)
      SELECT t AS trigram, count(*) AS docs, sum(n)::BIGINT AS sizes FROM dp GROUP BY 1""",
    "search_batch_topk": f"""WITH {_PAIRS} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10""",
    "search_batch_matches": f"WITH {_PAIRS} SELECT item_id, count(*) AS matches, round(sum(score), 4) AS score_sum FROM scored GROUP BY 1",
}
