"""Near-duplicate documents: Jaccard join of word shingles by prefixes with token combinations.

Shingles have a global order: rare ones by hash, then the frequent ones by count. Two sets that link lack so few of each
other's shingles that their prefixes in this order must meet. A rare shingle in the prefix is a signature by itself. The
frequent ones are dealt into classes by hash; there a pair of shingles of one class is a signature, and the prefix is
extended by a shingle for each class, because sets that share no pair may still share one shingle of each class:

    rare shingles + sum over classes of (shingles in the class - 1) >= shingles that may be missing + 1

Sets of equal signature are compared with the one that has the fewest rare shingles; what that does not connect is compared
in blocks. Parity sketches that grow with the set (an exact bound on the difference) go first, the sets themselves decide.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlframe.llm.common import map_rows, removed, stored, table
from crawlframe.llm.graph import components
from crawlframe.llm.words import MIX, grouped, scramble, shingles

#: A shingle is frequent from this many occurrences in (hash-ordered) prefixes on; if more than 400,000 are, from the least number
#: that fewer reach, because every task gets their table (6.4 MB). Occurrences are counted in groups of 2,000 documents; those
#: alone in their group are left out of the count (the order only decides the work, not the result).
FREQUENT, MOST_FREQUENT = 32, 400_000
#: Words of the smallest sketch, and of the largest form that travels with every signature into the blocks.
SKETCH_WORDS, FOLDED_WORDS = 16, 64
BLOCK = 400
STARS = 2
BLOOM_BITS = 1 << 23


class Threshold:
    """Links need 100 * common >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def spare(self, n: int) -> int:
        """Shingles of a set of n that a linked set may lack."""
        return n - -(-n * self.percent // 100)

    def band(self, n: int) -> int:
        """Size class; linked sets are in the same or in neighbouring ones."""
        return int(math.log(n) / -math.log(self.percent / 100 - 1e-4))

    def classes(self, band: int) -> int:
        """Number of classes of frequent shingles for sets of this size."""
        size = (self.percent / 100 - 1e-4) ** -band
        return max(1, int(size * (100 - self.percent) / 200))

    def signatures(self, tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
        """Signatures of a set of sorted shingles, and its number of rare shingles in the prefix.

        A set so small that it may lack no shingle and its partner can have none more only links with an equal set, and
        has no signature.
        """
        n = len(tokens)
        if n == 0 or 100 * n < self.percent * (n + 1):
            return np.zeros(0, np.int64), 0
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        often = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
        need = self.spare(n) + 1
        rare = tokens[~often][:need]
        out = [scramble(rare)]
        if left := need - len(rare):
            common = tokens[often][np.lexsort((tokens[often], counts[at[often]]))]
            for band in (self.band(n), self.band(n) + 1):
                kind = (common >> np.uint64(17)) % np.uint64(self.classes(band))
                again = np.ones(len(common), bool)
                again[np.unique(kind, return_index=True)[1]] = False
                end = int(np.searchsorted(np.cumsum(again), left)) + 1
                order = np.argsort(kind[:end], kind="stable")
                t, k = common[:end][order], kind[:end][order]
                start = np.searchsorted(k, k)
                for gap in range(1, end):
                    ok = np.arange(gap, end) - gap >= start[gap:end]
                    if not ok.any():
                        break
                    a, b = t[:end - gap][ok], t[gap:][ok]
                    lo, hi = np.minimum(a, b), np.maximum(a, b)
                    out.append(scramble((lo * MIX + hi) * MIX + np.uint64(band + 1)))
        return np.unique(np.concatenate(out)).view(np.int64), len(rare)


def identity(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell the set."""
    a, b = tokens.sum(dtype=np.uint64), scramble(tokens ^ MIX).sum(dtype=np.uint64)
    return int(np.int64(a)), int(np.int64(b))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of some hash buckets, 64 to a word: a power of two, from 2 a shingle on."""
    words = max(SKETCH_WORDS, 1 << (len(tokens) // 32).bit_length())
    bits = np.bincount((tokens % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch over fewer buckets; a shorter one stays."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words)) if len(bits) > words else bits


def no_further(n: Column, m: Column, apart: Column, percent: int) -> Column:
    """Whether sets of n and m shingles may link if ``apart`` is a lower bound on those in one of them only."""
    return (100 + percent) * apart <= (100 - percent) * (n + m)


def bloom_hashes(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(BLOOM_BITS)) for k in range(2)]


def bloom(ids: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of fixed size over the ids."""
    words = (
        ids.select(F.explode(F.array(*bloom_hashes(key))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("b")).collect()
    )
    out = np.zeros(BLOOM_BITS >> 6, np.int64)
    for r in words:
        out[r["w"]] = r["b"]
    return out


def most_frequent(often: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (``often``) and their ``count``, sorted by shingle: those of the largest counts, ``most`` at most."""
    steps = often.groupBy("count").agg(F.count("*").alias("k")).select("count", F.sum("k").over(W.orderBy(F.desc("count"))).alias("k"))
    least = steps.where(F.col("k") <= most).agg(F.min("count")).first()[0]
    rows = often.where(F.col("count") >= F.lit(least)).toArrow()
    tokens, counts = rows["often"].to_numpy().view(np.uint64), rows["count"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def forest(apart: np.ndarray, a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> list[int]:
    """Of the pairs (a, b) of members of the components ca and cb the closest ones that hold all of them together."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    out = []
    for i in np.lexsort((b, a, apart)).tolist():
        x, y = top(int(ca[i])), top(int(cb[i]))
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append(i)
    return out


def block_pairs(rows: DataFrame, sketches: DataFrame, key: str, percent: int, spanning: bool) -> DataFrame:
    """Pairs (a, b) of ``rows`` (key, id, n, c) of equal key and different components c whose sketches leave room for a link; if
    ``spanning``, of each block only so many that the same documents hang together."""
    main = rows.groupBy(key).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.mode("c", True).alias("main"))
    main = main.where("lo < hi").drop("lo", "hi")
    rest = rows.join(main, key)
    other = rest.groupBy(key).agg(F.sum((F.col("c") != F.col("main")).cast("long")).alias("q"))
    rest = rest.join(other, key).withColumns({
        "nt": F.ceil(F.col("m") / BLOCK).cast("int"), "nq": F.ceil(F.col("q") / BLOCK).cast("int")})
    piece = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    asks = rest.where("c <> main").select(key, "id", "n", "c", "main", F.lit(1).alias("ask"), piece("nq").alias("i"),
                                          F.explode(F.sequence(F.lit(0), F.col("nt") - 1)).alias("j"))
    told = rest.select(key, "id", "n", "c", "main", F.lit(0).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("i"),
                       piece("nt").alias("j"))
    met = asks.unionByName(told).join(sketches.select("id", F.coalesce("folded", "sketch").alias("sketch")), "id")

    def compare(rows: dict):
        ask = np.array(rows["ask"], bool)
        ids, n, c = (np.array(rows[x], np.int64) for x in ("id", "n", "c"))
        bits = [np.array(s, np.int64) for s in rows["sketch"]]
        words = np.array([len(b) for b in bits])
        levels = []
        for size in sorted({SKETCH_WORDS, *words.tolist()}):  # of each size the rows that have it, folded to it
            at = np.nonzero(words >= size)[0]
            place = np.zeros(len(bits), np.int64)
            place[at] = np.arange(len(at))
            levels.append((size, place, np.array([folded(bits[x], size) for x in at.tolist()]).view(np.uint64)))
        q, t = np.nonzero(ask)[0], np.nonzero(~ask)[0]
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in q.tolist():
            ok = (c[t] != c[i]) & ((ids[t] > ids[i]) | (c[t] == rows["main"][0]))
            ok &= (np.minimum(n[t], n[i]) * 100 >= np.maximum(n[t], n[i]) * percent)
            j = t[ok]
            apart = np.zeros(len(j), np.int64)
            for size, place, m in levels:
                if len(j) == 0 or words[i] < size:
                    break
                fit = words[j] >= size
                apart[fit] = np.bitwise_count(m[place[j[fit]]] ^ m[place[i]]).sum(1, dtype=np.int64)
                close = (100 + percent) * apart <= (100 - percent) * (n[j] + n[i])
                j, apart = j[close], apart[close]
            if len(j):
                near.append((apart, np.full(len(j), i), j))
        if not near:
            return None
        apart, i, j = (np.concatenate(x) for x in zip(*near, strict=True))
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        kept = forest(apart, a, b, c[i], c[j]) if spanning else slice(None)
        return {"a": a[kept].tolist(), "b": b[kept].tolist()}

    return grouped(met, [key, "i", "j"], compare, "a long, b long").distinct()


def by_sketch(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for a link, with their sizes na and nb."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    half = lambda s, size: F.when(F.size(s) > size, F.zip_with(F.slice(s, 1, size), F.slice(s, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(s))
    size = F.least(F.size("sa"), F.size("sb"))  # the larger of two sketches folds to the size of the other
    apart = F.aggregate(F.zip_with(half("sa", size), half("sb", size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(no_further(F.col("na"), F.col("nb"), apart, percent))
    return close.select("a", "b", "na", "nb")


def verified(close: DataFrame, docs: DataFrame, k: int, percent: int, label: str) -> DataFrame:
    """The pairs (a, b) of ``close`` whose sets link, stored; ``docs`` has id and text. A Bloom filter of fixed size picks the texts."""
    close = stored(close, "close-pairs")
    ids = close.select(F.explode(F.array("a", "b")).alias("id"))
    sent = docs.sparkSession.sparkContext.broadcast(bloom(ids, "id"))

    def work(rows: dict):
        bits = sent.value
        out: dict[str, list] = {"id": [], "tokens": []}
        for i, t, x, y in zip(rows["id"], rows["text"], rows["x"], rows["y"], strict=True):
            if all(int(bits[h >> 6]) >> (h & 63) & 1 for h in (x, y)):
                tokens = shingles(t, k)
                out["id"].append(i)
                out["tokens"].append(tokens.view(np.int64))
        return out

    x, y = bloom_hashes("id")
    full = map_rows(docs.select("id", "text", x.alias("x"), y.alias("y")), work, "id long, tokens array<long>")
    full = stored(full.join(ids.distinct(), "id"), "verified-sets")
    of = lambda c: full.dropDuplicates(["id"]).select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}"))
    both = F.size(F.array_intersect("ta", "tb"))
    links = close.join(of("a"), "a").join(of("b"), "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")
    links = stored(links, label)
    removed(close, full)
    return links


def near_documents(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every row: documents linked by k-word shingles.

    Two rows link when 100 * common shingles >= percent * union. A text of fewer than k words is one shingle; null, empty and
    blank texts have none and link with nothing. ``component_id`` is the smallest key reachable, the row's own included.
    Rows of a null key link with nothing (component null). A repeated key gives one row each, with the component of its
    own text. Shingles are compared by 64-bit hashes.
    """
    limit = Threshold(percent)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def read(rows: dict):
        out: dict[str, list] = {c: [] for c in ("id", "n", "s1", "s2", "often", "times")}
        for at in range(0, len(rows["id"]), 2_000):
            low = []
            for i, t in zip(rows["id"][at:at + 2_000], rows["text"][at:at + 2_000], strict=True):
                tokens = shingles(t, k)
                s1, s2 = identity(tokens)
                low.append(tokens[:limit.spare(len(tokens)) + 1])
                for c, v in (("id", i), ("n", len(tokens)), ("s1", s1), ("s2", s2), ("often", None), ("times", None)):
                    out[c].append(v)
            t, c = np.unique(np.concatenate(low), return_counts=True)
            out["often"][-1], out["times"][-1] = t[c > 1].view(np.int64), c[c > 1]
        return out

    schema = "id long, n long, s1 long, s2 long, often array<long>, times array<long>"
    first = stored(map_rows(docs, read, schema), "shingle-sets")
    rep = first.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
    rep = stored(rep, "shingle-classes")
    often = first.where("often IS NOT NULL").select(F.explode(F.arrays_zip("often", "times")).alias("e")).groupBy("e.often").agg(
        F.sum("e.times").alias("count")).where(F.col("count") >= FREQUENT)
    often = stored(often, "frequent-shingles")
    sent = docs.sparkSession.sparkContext.broadcast(most_frequent(often, MOST_FREQUENT))
    removed(often)

    def sign(rows: dict):
        out: dict[str, list] = {c: [] for c in ("id", "n", "rare", "sketch", "folded", "sigs")}
        for i, t in zip(rows["id"], rows["text"], strict=True):
            tokens = shingles(t, k)
            sigs, rare = limit.signatures(tokens, *sent.value)
            bits = sketch(tokens)
            low = folded(bits, FOLDED_WORDS) if len(bits) > FOLDED_WORDS else None
            for c, v in (("id", i), ("n", len(tokens)), ("rare", rare), ("sketch", bits), ("folded", low), ("sigs", sigs)):
                out[c].append(v)
        return out

    signed = map_rows(docs.where("id IS NOT NULL"), sign, "id long, n long, rare int, sketch array<long>, folded array<long>, sigs array<long>")
    signed = stored(signed, "signatures")
    posting = signed.select("id", "n", "rare", F.explode("sigs").alias("sig"))
    # by size, a signature is cut where the next set is too large for the one before: no link crosses the cut
    one = W.partitionBy("sig").orderBy("n", "id")
    shared = posting.withColumns({"p": F.lag("n").over(one), "q": F.lead("n").over(one)}).withColumns({
        "p": F.coalesce(F.col("p") * 100 >= F.col("n") * percent, F.lit(False)), "q": F.coalesce(F.col("n") * 100 >= F.col("q") * percent, F.lit(False))})
    shared = shared.withColumn("run", F.sum((~F.col("p")).cast("long")).over(one.rowsBetween(W.unboundedPreceding, 0))).where("p OR q")
    shared = shared.withColumn("sig", F.xxhash64("sig", "run"))
    cut = stored(shared.drop("p", "q", "run"), "shared-signatures")
    shared = cut.join(rep.select(F.col("rep").alias("id")), "id", "left_semi").distinct()
    # of signatures with the same members one is enough
    members = shared.groupBy("sig").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
        F.min(F.struct("rare", "id", "n")).alias("hub")).where("m > 1")
    members = members.groupBy("m", "x", "y").agg(F.min("sig").alias("sig"), F.min("hub").alias("hub"))
    shared = stored(shared.join(members.select("sig", "hub"), "sig").select("sig", "id", "n", "rare", "hub"), "signature-members")
    sketches = signed.join(rep.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "sketch", "folded").dropDuplicates(["id"])
    sketches = stored(sketches.join(shared.select("id"), "id", "left_semi"), "sketches")
    removed(cut, signed)
    left, edges, before = shared.drop("hub"), None, []
    for turn in range(STARS):  # each signature's members are held against one of them, then the rest against one of the rest
        hubs = left.groupBy("sig").agg(F.min(F.struct("rare", "id", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1")
        star = left.join(hubs, "sig").where("id <> hub.id")
        may = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
        pairs = star.where(may).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
        more = verified(by_sketch(pairs, sketches, percent), docs, k, percent, f"star-links-{turn}")
        edges = more if edges is None else edges.unionByName(more)
        groups = components(edges)
        of_id = groups.select(F.col("node").alias("id"), F.col("component").alias("c"))
        of_hub = groups.select(F.col("node").alias("_hub"), F.col("component").alias("h"))
        named = star.join(of_id, "id", "left").join(of_hub, F.col("hub.id") == F.col("_hub"), "left")
        left = stored(named.where("h IS NULL OR c IS NULL OR c <> h").select("sig", "id", "n", "rare"), f"unconnected-{turn}")
        removed(*before)
        before = [left]

    # what the stars did not connect: members of different components that share a signature, in blocks
    member = shared.join(groups, F.col("id") == F.col("node"), "left").select(
        "sig", "id", "n", F.coalesce("component", "id").alias("c"), F.col("hub.id").alias("hub"))
    member = stored(member.where("id <> hub").drop("hub"), "members")
    removed(shared, left)
    tried = stored(block_pairs(member, sketches, "sig", percent, True), "block-pairs")
    removed(member)
    more = verified(by_sketch(tried, sketches, percent), docs, k, percent, "block-links")
    edges = edges.unionByName(more)
    # where a pair that held documents together is no link, another one of theirs may be: all of them are compared, by document
    failed = tried.join(more, ["a", "b"], "left_anti")
    whole = components(edges.unionByName(tried)).withColumnRenamed("component", "around")
    again = whole.join(failed.select(F.col("a").alias("node")), "node").select("around").distinct()
    again = whole.join(again, "around").join(components(edges), "node", "left").withColumn("c", F.coalesce("component", "node"))
    again = again.select("around", F.col("node").alias("id"), "c").join(sketches.select("id", "n"), "id")
    again = stored(again, "loose-members")
    loose = stored(block_pairs(again, sketches, "around", percent, False), "loose-pairs")
    removed(again)
    last = by_sketch(loose, sketches, percent).join(tried, ["a", "b"], "left_anti")
    more = verified(last, docs, k, percent, "loose-links")
    removed(loose, tried, sketches)
    reps = components(edges.unionByName(more)).select(F.col("node").alias("rep"), "component")
    named = rep.join(reps, "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    whole = first.select("id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return whole.select(F.col("id").cast(dict(df.dtypes)[key]).alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents by 3-word shingles at 90 %."""
    return near_documents(table(spark, folder, "documents"), 3, 90)


ORACLE_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
