"""Benchmark decontamination: word windows of test items, found in training texts by a broadcast hash set of n-grams.

Any stretch of m words holds a whole aligned block of (m + 1) // 2 words of the text around it, wherever the stretch begins.
So a document is cut into consecutive blocks, and only these are looked up in the set of all n-grams of that length
inside the windows: one look-up for five words instead of one for each. A hit says where its window must lie;
the words there are compared before it counts. Column expressions only; the set is broadcast if its measured size
is small and joined by a shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crawlframe.llm.common import stored, table
from crawlframe.session import small_or_shuffled

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: all of ASCII but digits and letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def normalised(text: Column) -> Column:
    """The words in lower case (A-Z only), each followed by one space; empty without words or text."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    spaced = F.ltrim(F.regexp_replace(low, BETWEEN, " "))
    return F.when(spaced == "", "").otherwise(F.concat(F.rtrim(spaced), F.lit(" ")))


def count_words(norm: Column) -> Column:
    """Words of a normalised text."""
    return (F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit("")))).cast("long")


def windows(benchmark: DataFrame, size: int = WINDOW, text: str = "text", key: str = "item_id") -> DataFrame:
    """Distinct (item, window, m): every run of ``size`` words of an item, or all words of a shorter one; none without words.

    ``window`` has its words each followed by a space, ``m`` is their number, ``item`` the id as text. A null id stays null.
    """
    words = F.filter(F.split(normalised(F.col(text)), " "), lambda w: w != "")
    items = benchmark.select(F.col(key).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    items = items.withColumn("m", F.least(F.size("w"), F.lit(size)))
    start = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at")
    cut = items.select("item", "w", "m", start)
    return cut.select("item", F.concat(F.array_join(F.slice("w", F.col("at"), F.col("m")), " "), F.lit(" ")).alias("window"), "m").distinct()


def grams(wins: DataFrame) -> DataFrame:
    """(b, gram, off, window, m): the n-grams of ``b = (m + 1) // 2`` words of each window, ``off`` words from its start."""
    w = wins.select("window", "m").distinct().withColumns({
        "w": F.split(F.rtrim("window"), " "), "b": F.floor((F.col("m") + 1) / 2).cast("int")})
    w = w.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("b"))))
    gram = F.concat(F.array_join(F.slice("w", F.col("off") + 1, F.col("b")), " "), F.lit(" "))
    return w.select("b", gram.alias("gram"), "off", "window", "m")


def occurrences(docs: DataFrame, wins: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (row, key, n_words, null...) for each row of ``docs``, and one (row, key, null, at, m, window) for each hit of a block.

    ``row`` numbers the rows of ``docs`` (repeated and null keys stay apart), ``at`` is the first word of the window. The
    same window at the same place may come more than once. The set's blocks have at most WINDOW // 2 lengths; a document
    is cut once for each length that occurs.
    """
    lengths = sorted(r["b"] for r in wins.select(F.floor((F.col("m") + 1) / 2).cast("int").alias("b")).distinct().collect())
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), normalised(F.col(text)).alias("norm"))
    none = F.lit(None)
    shape = "array<struct<b:int,i:int,gram:string,before:string,after:string,n_words:long>>"
    cuts = [F.array(F.struct(F.lit(0), none, none, none, none, count_words(F.col("norm")))).cast(shape)]

    def placed(b: int, blocks: Column) -> Column:
        """The blocks with their neighbours; get() is null beyond the ends."""
        return F.transform(blocks, lambda g, i: F.struct(F.lit(b), i, g, F.get(blocks, i - 1), F.get(blocks, i + 1), none)).cast(shape)

    for b in lengths:
        base = base.withColumn(f"blocks{b}", F.regexp_extract_all("norm", F.lit(f"(?:[^ ]++ ){{1,{b}}}+"), F.lit(0)))
        cuts.append(placed(b, F.col(f"blocks{b}")))
    rows = base.select("row", "key", F.explode(F.concat(*cuts)).alias("e")).select("row", "key", "e.*")
    hits = rows.join(small_or_shuffled(grams(wins)), ["b", "gram"], "left")
    # words of the block and its neighbours; the window must lie at this place in them
    around = F.split(F.rtrim(F.concat(F.coalesce("before", F.lit("")), F.col("gram"), F.coalesce("after", F.lit("")))), " ")
    left = F.when(F.col("before").isNull(), 0).otherwise(F.col("b")) - F.col("off")
    held = F.concat(F.array_join(F.slice(around, left + 1, F.col("m")), " "), F.lit(" ")) == F.col("window")
    fine = F.when(F.col("b") == 0, True).when(F.col("window").isNull(), False).when(left < 0, False).otherwise(held)
    return hits.where(fine).select("row", "key", "n_words", (F.col("i").cast("long") * F.col("b") - F.col("off")).alias("at"), "m", "window")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", key: str = "doc_id",
                  item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """For each row of ``docs``: row, ``key``, n_words, n_hit, items (sorted texts) and spans (from, to: words, disjoint, in order).

    A word is hit if it lies in an occurrence of a window. Null, empty and wordless texts have no words, no hits, no items;
    wordless items have no windows. Rows of one key are judged each by itself; a null key is kept. Windows of an item without an
    id hit words but name no item; items of one id count once. Other columns of both frames are not used, whatever they are called.
    """
    wins = stored(windows(benchmark, size, item_text, item_key), "benchmark-windows")
    found = stored(occurrences(docs, wins, text, key), "benchmark-hits")
    places = found.where("at IS NOT NULL").groupBy("row", "at").agg(F.max("m").alias("m"))
    # a document's places are at most its words; merged as a sorted stream
    order = W.partitionBy("row").orderBy("at")
    reach = places.withColumn("end", F.col("at") + F.col("m")).withColumn(
        "before", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    fresh = F.when(F.col("before").isNull() | (F.col("at") > F.col("before")), 1).otherwise(0)
    runs = reach.withColumn("run", F.sum(fresh).over(order)).groupBy("row", "run").agg(F.min("at").alias("a"), F.max("end").alias("b"))
    spans = runs.groupBy("row").agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    held = found.where("at IS NOT NULL").select("row", "window").distinct().join(small_or_shuffled(wins.select("window", "item")), "window")
    items = held.where("item IS NOT NULL").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    whole = found.where("at IS NULL").select("row", "key", "n_words")
    whole = whole.join(spans, "row", "left").join(items, "row", "left")
    return whole.select(
        "row", F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<a:long,b:long>>")).alias("spans"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans, each taken with what stands before it. Null stays null."""
    pieces = F.regexp_extract_all(text, F.lit("[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*+[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]++"), F.lit(0))
    tail = F.regexp_extract(text, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*$", 0)
    left = F.filter(pieces, lambda p, i: ~F.exists(spans, lambda s: (s["a"] <= i) & (i < s["b"])))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(left, ""), tail))


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: float | None = None, size: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without what the benchmark's windows hit: the hit words, or (``most`` given) documents with a larger share of hit words.

    The documents that are kept under ``most`` keep their whole text. ``key`` must be unique and not null among the documents, so
    that texts meet their spans.
    """
    marks = contamination(docs, benchmark, size, text, key).where("n_hit > 0").select(
        F.col(key).alias("_key"), F.struct("n_hit", "n_words", "spans").alias("_mark"))
    both = docs.join(marks, docs[key] == F.col("_key"), "left")
    if most is None:
        cut = F.when(F.col("_mark").isNull(), F.col(text)).otherwise(without_spans(F.col(text), F.col("_mark.spans")))
        return both.withColumn(text, cut).select(*docs.columns)
    return both.where(F.col("_mark").isNull() | (F.col("_mark.n_hit") <= most * F.col("_mark.n_words"))).select(*docs.columns)


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Hit words and items of every document, windows of ten words (nulls, repeats and empty tables: see ``contamination``)."""
    marks = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return marks.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_DECONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t
        FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
pos AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m),
hit AS (SELECT pos.r, pos.i, pos.m, win.item_id FROM pos JOIN win ON win.m = pos.m AND win.t = array_to_string(pos.w[pos.i:pos.i + pos.m - 1], ' ')),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN it ON it.r = d.r
"""
