"""Phrase collocations by stripes: every prefix keys an associative counter of the words that follow it.

A task counts the words of many texts of one language into nested stripes: word -> next word -> third word, each with its
count. A stripe is cut by the hash of its next word into pieces (so that no frequent word's stripe is in one place), and all
pieces of a bucket travel as one row of packed numbers. Equal pieces merge element by element. The merged structure holds the
extensions of each prefix (the candidates), the totals of the prefixes, and of each pair the most frequent third word, which
tells whether the pair is only a part of a longer phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlframe.llm.common import arrow_schema, stored, table
from crawlframe.llm.words import MIX, scramble
from crawlframe.session import small_or_shuffled

LEAST, TOP = 10, 2_000
#: Parts of a longer phrase that has at least this percentage of their count go.
SUBSUMED = 50
#: Words that a task counts before it sends its stripes on; pieces of a stripe, by the next word's hash.
AT_ONCE, PIECES = 4_000_000, 64
#: Not a byte of any UTF-8 text: stands between the pieces of a text.
CUT = b"\xff"
SEPARATORS = bytes.maketrans(b".,;:!?\x0A\x0B\x0C\x0D\x09", CUT * 10 + b" ")
PACKED = "lang string, bucket int, h binary, c binary, texts array<string>, w1 binary, w2 binary, c2 binary, n3 binary, w3 binary, c3 binary"
COUNTED = "lang string, kind int, h1 long, h2 long, h3 long, f long, longest long, word string"


class Ids(dict):
    """Numbers of words in order of appearance; 0 is the cut."""

    def __init__(self):
        super().__init__({CUT: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), with a cut after every piece."""
    return (text or "").encode().lower().translate(SEPARATORS).replace(CUT, b" \xff ").split() + [CUT]


def stripes(words: np.ndarray, ids: Ids) -> dict[str, np.ndarray | list]:
    """Nested counters of a run of word numbers: of words (h, c, texts), of pairs (w1, w2, c2, n3), of triples (w3, c3: n3 for each pair)."""
    names = list(ids)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    t = words.astype(np.int64)
    at = np.nonzero((t[:-1] > 0) & (t[1:] > 0))[0]
    pair, rank, c2 = np.unique(t[at] << 32 | t[at + 1], return_inverse=True, return_counts=True)
    of = np.full(len(t) + 1, -1, np.int64)
    of[at] = rank
    at = at[of[at + 1] >= 0]
    triple, c3 = np.unique(of[at] << 32 | t[at + 2], return_counts=True)
    return {
        "h": h[1:], "c": np.bincount(t, minlength=len(names))[1:], "texts": [w.decode() for w in names[1:]],
        "w1": h[pair >> 32], "w2": h[pair & 0xFFFFFFFF], "c2": c2, "n3": np.bincount(triple >> 32, minlength=len(pair)),
        "w3": h[triple & 0xFFFFFFFF], "c3": c3,
    }


def bucketed(lang: str, s: dict, buckets: int) -> Iterator[dict]:
    """The stripes as one packed row a bucket."""
    of_word = (scramble(s["h"]) % np.uint64(buckets)).astype(np.int64)
    of_pair = (scramble(s["w1"] * MIX + s["w2"] % np.uint64(PIECES)) % np.uint64(buckets)).astype(np.int64)
    of_triple = np.repeat(of_pair, s["n3"])
    cols = {}
    for names, of in ((("h", "c"), of_word), (("w1", "w2", "c2", "n3"), of_pair), (("w3", "c3"), of_triple)):
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(buckets + 1))
        for n in names:
            cols[n] = (s[n][order].astype(np.uint64 if n[0] in "hw" else np.uint32), ends)
        if "h" in names:
            texts = [s["texts"][i] for i in order.tolist()], ends
    for b in range(buckets):
        cut = {n: x[ends[b]:ends[b + 1]].tobytes() for n, (x, ends) in cols.items()}
        if cut["h"] or cut["w1"]:
            yield {"lang": lang, "bucket": b, "texts": texts[0][texts[1][b]:texts[1][b + 1]]} | cut


def count_stripes(docs: DataFrame, buckets: int, at_once: int = AT_ONCE) -> DataFrame:
    """Packed stripes of ``docs`` (lang, text)."""

    target = arrow_schema(PACKED)

    def run(parts):
        held: dict[str, tuple[Ids, list[np.ndarray]]] = {}
        size = 0

        def flush():
            for lang, (ids, words) in held.items():
                rows = list(bucketed(lang, stripes(np.concatenate(words), ids), buckets))
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[at:at + 64], schema=target)
            held.clear()

        for part in parts:
            for lang, text in zip(part.column("lang"), part.column("text"), strict=True):
                got = tokens(text.as_py())
                ids, words = held.setdefault(lang.as_py(), (Ids(), []))
                words.append(np.fromiter(map(ids.__getitem__, got), np.uint32, len(got)))
                size += len(got)
                if size >= at_once:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, PACKED)


def summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (columns, in order of the first) and the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.nonzero(new)[0]
    return [k[at] for k in keys], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def merged(rows: list[dict], least: int) -> dict[str, list]:
    """Counts of a bucket's stripes: words (kind 1, with text), pairs (2, with the count of the most frequent third word) and triples (3)
    of at least ``least`` occurrences, and one row (kind 0) with the number of all word occurrences."""
    whole = lambda n, kind: np.frombuffer(b"".join(r[n] for r in rows), kind)
    out: dict[str, list] = {c: [] for c in ("kind", "h1", "h2", "h3", "f", "longest", "word")}

    def put(kind, h, f, longest=None, word=None):
        n, none = len(f), [None] * len(f)
        long = [x.view(np.int64).tolist() for x in h]
        for c, v in zip(out, ([kind] * n, *long, *[none] * (3 - len(h)), f.tolist(), longest if longest is not None else none, word or none), strict=True):
            out[c] += v

    h, c = whole("h", np.uint64), whole("c", np.uint32).astype(np.int64)
    put(0, [], np.array([c.sum()]))
    (one,), f = summed([h], c)
    one, f = one[f >= least], f[f >= least]
    texts = dict.fromkeys(one.tolist())
    for r in rows:
        for k, t in zip(np.frombuffer(r["h"], np.uint64).tolist(), r["texts"], strict=True):
            if k in texts:
                texts[k] = t
    put(1, [one], f, word=[texts[k] for k in one.tolist()])
    w1, w2, n3 = whole("w1", np.uint64), whole("w2", np.uint64), whole("n3", np.uint32)
    pair, f = summed([w1, w2], whole("c2", np.uint32).astype(np.int64))
    pair, f = [k[f >= least] for k in pair], f[f >= least]
    triple, g = summed([np.repeat(w1, n3), np.repeat(w2, n3), whole("w3", np.uint64)], whole("c3", np.uint32).astype(np.int64))
    triple, g = [k[g >= least] for k in triple], g[g >= least]
    # both are in order of (w1, w2), and the pair of a frequent triple is frequent
    longest = np.zeros(len(f), np.int64)
    if len(g):
        new = np.r_[True, (triple[0][1:] != triple[0][:-1]) | (triple[1][1:] != triple[1][:-1])]
        place = {k: i for i, k in enumerate(zip(pair[0].tolist(), pair[1].tolist(), strict=True))}
        at = [place[k] for k in zip(triple[0][new].tolist(), triple[1][new].tolist(), strict=True)]
        longest[at] = np.maximum.reduceat(g, np.nonzero(new)[0])
    put(2, pair, f, longest=longest.tolist())
    put(3, triple, g)
    return out


def merge_stripes(packed: DataFrame, least: int = LEAST) -> DataFrame:
    """Stripes of equal buckets added up (see ``merged``); a task holds one bucket of one language at a time."""

    target = arrow_schema(COUNTED)

    def run(parts):
        key, rows = None, []

        def flush():
            if rows:
                out = merged(rows, least)
                out["lang"] = [key[0]] * len(out["kind"])
                yield pa.RecordBatch.from_pydict(out, schema=target)

        for part in parts:
            for at in range(part.num_rows):
                (row,) = part.slice(at, 1).to_pylist()
                if (row["lang"], row["bucket"]) != key:
                    yield from flush()
                    key, rows = (row["lang"], row["bucket"]), []
                rows.append(row)
        yield from flush()

    return packed.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(run, COUNTED)


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers; at most 1000000, as a is at most either part."""
    big = lambda c: c.cast("decimal(14,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right)).cast("long")


def counted_stripes(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text") -> DataFrame:
    """The merged stripes of a whole corpus, stored."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return stored(merge_stripes(count_stripes(docs, buckets), least), "stripes")


def candidates(counts: DataFrame) -> DataFrame:
    """All phrases of two or three words that are not part of a longer one: lang, phrase, a, l, r, score of the lowest cut."""
    kind = lambda n: counts.where(F.col("kind") == n)
    one = stored(kind(1).select("lang", F.col("h1").alias("h"), F.col("f").alias("n"), "word"), "frequent-words")
    two = kind(2).select("lang", "h1", "h2", "f", "longest")
    three = kind(3).select("lang", "h1", "h2", "h3", "f")

    def named(df: DataFrame, h: str) -> DataFrame:
        words = small_or_shuffled(one.select(F.col("lang").alias("_l"), F.col("h").alias("_h"), F.col("n").alias(f"n_{h}"), F.col("word").alias(f"t_{h}")))
        return df.join(words, (F.col("lang") == F.col("_l")) & (F.col(h) == F.col("_h"))).drop("_l", "_h")

    before = three.groupBy("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2")).agg(F.max("f").alias("before"))
    pairs = two.join(before, ["lang", "h1", "h2"], "left")
    free = 100 * F.greatest("longest", F.coalesce("before", F.lit(0))) < SUBSUMED * F.col("f")
    pairs = named(named(pairs.where(free), "h1"), "h2").select(
        "lang", F.concat_ws(" ", "t_h1", "t_h2").alias("phrase"), F.col("f").alias("a"), F.col("n_h1").alias("l"), F.col("n_h2").alias("r"),
        cut_score(F.col("f"), F.col("n_h1"), F.col("n_h2")).alias("score"))
    part = lambda a, b, n: two.select("lang", F.col("h1").alias(a), F.col("h2").alias(b), F.col("f").alias(n))
    triples = three.join(part("h1", "h2", "head"), ["lang", "h1", "h2"]).join(part("h2", "h3", "tail"), ["lang", "h2", "h3"])
    triples = named(named(named(triples, "h1"), "h2"), "h3").withColumns({
        "s1": cut_score(F.col("f"), F.col("n_h1"), F.col("tail")), "s2": cut_score(F.col("f"), F.col("head"), F.col("n_h3"))})
    early = F.col("s1") <= F.col("s2")
    triples = triples.select(
        "lang", F.concat_ws(" ", "t_h1", "t_h2", "t_h3").alias("phrase"), F.col("f").alias("a"),
        F.when(early, F.col("n_h1")).otherwise(F.col("head")).alias("l"), F.when(early, F.col("tail")).otherwise(F.col("n_h3")).alias("r"),
        F.least("s1", "s2").alias("score"))
    return pairs.unionByName(triples)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und`` (as one of that name), a null text is empty; empty texts hold no words. Repeated rows count each. Ties
    go by count, then by the phrase's UTF-8 bytes. Languages without a candidate have no rows. Other columns are not looked at.
    Words are told apart by 64-bit hashes.
    """
    counts = counted_stripes(docs, least, lang, text)
    total = counts.where("kind = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the first ones of each share, then the first ones of all: no language is ranked by one task
    found = candidates(counts).withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    few = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= top)
    first = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of every language of ``documents``."""
    return collocations(table(spark, folder, "documents"))


ORACLE_COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT c.lang, c.k, c.phrase, a, x.f AS l, y.f AS r, i, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[i + 1:c.k], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
part AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM part GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN most USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
