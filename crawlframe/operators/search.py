"""Trigram search: one query over all pages, and many queries over a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.functions.lang import let, unnest
from crawlframe.functions.text import set_similarity, similarity, trigrams
from crawlframe.session import fits

# Search defaults.
THRESHOLD = 0.1
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
#: Documents and queries whose shared trigrams are counted at once.
ROWS, COLUMNS = 256, 512


def score_pages(pages: DataFrame, query: str, threshold: float = THRESHOLD) -> DataFrame:
    """Pages whose title or snippet matches the query, with their score."""
    wanted = trigrams(F.lit(query))

    def sim(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), let(trigrams(F.col(name)), lambda g: similarity(g, wanted)))

    # The test runs inside the generated array: as a plain filter it would be pushed below the
    # projection and every similarity computed twice.
    scores = F.array(F.struct(sim("title").alias("title"), sim("text_snippet").alias("text")))
    matching = F.filter(scores, lambda s: (s["title"] >= threshold) | (s["text"] >= threshold))
    zero = F.lit(0.0)
    best = F.greatest(F.coalesce(F.col("_s.title"), zero), F.coalesce(F.col("_s.text"), zero))
    return unnest(pages, matching, "_s", keep=["*"]).withColumn("score", best).drop("_s")


def search_pages(pages: DataFrame, urls: DataFrame, query: str, limit: int = DEFAULT_LIMIT, offset: int = 0,
                 threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(page of ranked hits, one row with the total number of matches).

    Pages are scored before the join, so only matches are shuffled.
    """
    hits = score_pages(pages, query, threshold).join(
        urls.select(F.col("id").alias("url_id"), "canonical_url", "normalized_url", "domain"), "url_id"
    )
    ranked = (
        hits.select("title", F.col("canonical_url").alias("url"), "normalized_url", "description",
                    "text_snippet", "domain", "score")
        .orderBy(F.desc("score"), "normalized_url")
        .offset(offset).limit(min(limit, MAX_LIMIT))
    )
    return ranked, hits.agg(F.count("*").alias("total"))


def page_by_url_id(pages: DataFrame, urls: DataFrame, url_id) -> DataFrame:
    """One stored page with its URL; the filter reaches both scans."""
    fields = ["title", "description", "text_snippet", "language", "extracted_links", "metadata"]
    return pages.filter(F.col("url_id") == url_id).select("url_id", *fields).join(
        urls.filter(F.col("id") == url_id).select(
            F.col("id").alias("url_id"), F.col("canonical_url").alias("url"), "normalized_url", "domain"
        ),
        "url_id",
    )


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Trigram posting table (trigram, key, n) with n the size of the document's trigram set."""
    sets = docs.select(F.col(key), trigrams(F.col(text)).alias("_grams"))
    # The size is taken before the explode: else every row would carry the whole array along.
    sized = sets.select(key, "_grams", F.size("_grams").alias("n"))
    return unnest(sized, F.col("_grams"), "trigram", keep=[key, "n"])


def repeats(df: DataFrame, key: str) -> bool:
    """Whether a key is in more than one row."""
    return bool(df.groupBy(key).count().where("count > 1").head(1))


def scored_in_tasks(docs: DataFrame, doc_key: str, doc_text: str, asked: DataFrame, query_key: str, threshold: float) -> DataFrame:
    """``similarity_join`` with query postings that every task gets: the shared trigrams of some documents and some queries are one
    product of 0/1 matrices, and only pairs at the threshold leave the task."""
    posts = asked.toArrow()
    words = pc.unique(posts["trigram"].combine_chunks())
    names = posts[query_key].combine_chunks().dictionary_encode()
    at = pc.index_in(posts["trigram"], words).to_numpy()
    of = names.indices.to_numpy()
    size = np.zeros(len(names.dictionary), np.int64)
    size[of] = posts["n"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((words, names.dictionary, at, of, size))
    schema = T.StructType([T.StructField(query_key, asked.schema[query_key].dataType), T.StructField(doc_key, docs.schema[doc_key].dataType),
                           T.StructField("score", T.DoubleType())])

    def work(batches):
        words, names, at, of, size = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                keys, grams = part.column(0), part.column(1)
                n = pc.fill_null(pc.list_value_length(grams), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                place = pc.fill_null(pc.index_in(grams.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), n)[place >= 0]
                held = np.zeros((len(n), len(words)), np.float32)
                held[row, place[place >= 0]] = 1
                for first in range(0, len(names), COLUMNS):
                    q = size[first:first + COLUMNS]
                    here = (of >= first) & (of < first + COLUMNS)
                    wanted = np.zeros((len(words), len(q)), np.float32)
                    wanted[at[here], of[here] - first] = 1
                    shared = (held @ wanted).astype(np.int64)  # exact: far fewer than 2 ** 24
                    d, c = np.nonzero(shared)
                    common = shared[d, c]
                    score = common / (n[d] + q[c] - common)
                    ok = score >= threshold
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(c[ok] + first)), keys.take(pa.array(d[ok])), pa.array(score[ok])], [query_key, doc_key, "score"])

    return docs.select(doc_key, trigrams(F.col(doc_text)).alias("_grams")).mapInArrow(work, schema)


def similarity_join(docs: DataFrame, doc_key: str, doc_text: str, queries: DataFrame, query_key: str,
                    query_text: str, threshold: float = THRESHOLD, salts: int = 32,
                    max_rows: int = 500_000, max_bytes: int = 64 << 20) -> DataFrame:
    """(query, doc, score) for every pair at or above the threshold.

    Query postings within the measured bound are broadcast: the shared trigrams of a document are
    then counted in the task that holds it. Larger ones join on (trigram, salt), where the salt
    spreads the documents of a frequent trigram and the query side is repeated per salt. Rows that
    repeat a key count as one, which takes the join.
    """
    asked = postings(queries, query_key, query_text)
    small = fits(asked, max_rows, max_bytes)
    if small and not repeats(queries, query_key) and not repeats(docs, doc_key):
        return scored_in_tasks(docs, doc_key, doc_text, asked, query_key, threshold)
    asked = asked.withColumnRenamed("n", "qn")
    held = postings(docs, doc_key, doc_text).withColumnRenamed("n", "dn")
    if small:
        pairs = held.join(F.broadcast(asked), "trigram")
    else:
        held = held.withColumn("_salt", F.pmod(F.xxhash64(doc_key), F.lit(salts)).cast("int"))
        asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = held.hint("merge").join(asked, ["trigram", "_salt"])
    counted = pairs.groupBy(query_key, doc_key).agg(
        F.count("*").cast("int").alias("shared"), F.max("qn").alias("qn"), F.max("dn").alias("dn")
    )
    return (
        counted.withColumn("score", set_similarity(F.col("shared"), F.col("qn"), F.col("dn")))
        .filter(F.col("score") >= threshold).select(query_key, doc_key, "score")
    )


def best_per_query(scored: DataFrame, query_key: str, doc_key: str, k: int) -> DataFrame:
    """The k best documents of every query; each task sends at most k rows per query."""
    rank = Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key)
    return scored.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
