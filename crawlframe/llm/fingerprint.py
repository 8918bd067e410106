"""Document fingerprints that add up: sums of wide vectors hashed from paragraphs, modulo powers of two.

A paragraph (line) hashes to a vector: six lanes of 48 bits from the whole paragraph, and similarity lanes of 16 bits
from its sentences. A document's fingerprint is the lane-wise sum over its paragraphs, so the order of paragraphs does not
matter, and adding or removing a paragraph adds or subtracts its vector. A sentence adds to one lane per level; level l
takes about every 4^l-th sentence by hash, so that short and long documents both have a level with lanes of few sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlframe.llm.common import table

WIDE, LEVELS, LANES = 6, 5, 32
MASK = (1 << 48) - 1


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def sentences(text: Column) -> Column:
    """Non-empty stretches between line ends and full stops."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\n.]+"), lambda s: s != "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``{name}_wide`` (six 48-bit sums) and ``{name}_fine`` (LEVELS x LANES sums below 2^16).

    Bits of a sentence's hash: 0-4 lane, from 5 on level, 16-31 addend. Null counts as empty text, the empty text is one
    empty paragraph without sentences. Equal texts have equal fingerprints.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    lines = paragraphs(F.col(text))
    df = df.withColumn("_lines", lines).withColumn("_h0", F.transform(sentences(F.col(text)), lambda s: F.xxhash64(s)))
    no_bits = lambda mask: lambda h: h.bitwiseAND(F.lit(mask).cast("long")) == 0
    for k in range(1, LEVELS):
        df = df.withColumn(f"_h{k}", F.filter(f"_h{k - 1}", no_bits(((1 << (2 * k)) - 1) << 5)))

    def level(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: total(F.transform(
            F.filter(f"_h{k}", lambda h: h.bitwiseAND(F.lit(LANES - 1).cast("long")) == i), lambda h: F.shiftright(h, 16).bitwiseAND(F.lit(0xFFFF).cast("long")),
        )).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int"))

    def hashed(k: int) -> Column:
        return F.aggregate(
            F.transform("_lines", lambda p: F.xxhash64(p, F.lit(k)).bitwiseAND(F.lit(MASK))), F.lit(0).cast("long"),
            lambda a, x: (a + x).bitwiseAND(F.lit(MASK)))

    levels, wide = [level(k) for k in range(LEVELS)], F.array(*[hashed(k) for k in range(WIDE)])
    return df.withColumns({f"{name}_wide": wide, f"{name}_fine": F.concat(*levels)}).drop(
        "_lines", *[f"_h{k}" for k in range(LEVELS)])


def combine(wide: Column, fine: Column, other_wide: Column, other_fine: Column, sign: int = 1) -> tuple[Column, Column]:
    """Fingerprint after inserting (sign 1) or deleting (-1) the paragraphs that the other one sums up."""
    return (
        F.zip_with(wide, other_wide, lambda a, b: (a + b * sign).bitwiseAND(F.lit(MASK))),
        F.zip_with(fine, other_fine, lambda a, b: (a + b * sign).bitwiseAND(F.lit(0xFFFF)).cast("int")),
    )


def as_text(wide: Column, fine: Column) -> Column:
    """Hexadecimal digits of all lanes."""
    return F.concat(
        F.array_join(F.transform(wide, lambda x: F.lpad(F.hex(x), 12, "0")), ""),
        F.array_join(F.transform(fine, lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")), ""),
    )


def likeness(wide: Column, fine: Column, other_wide: Column, other_fine: Column) -> Column:
    """Estimated share of common sentences, 0 to 1; 1 for equal fingerprints.

    Of the levels, the first with at most three quarters of its lanes in use counts (else the last). Lanes in use tell the
    number of sentences in either text, lanes that differ the number of those in one only. Two different texts without a
    sentence at that level have 0.
    """
    levels = F.filter(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(
        k.alias("k"),
        F.size(F.filter(F.zip_with(F.slice(fine, k * LANES + 1, LANES), F.slice(other_fine, k * LANES + 1, LANES),
                                   lambda a, b: (a != 0) | (b != 0)), lambda x: x)).alias("used"),
        F.size(F.filter(F.zip_with(F.slice(fine, k * LANES + 1, LANES), F.slice(other_fine, k * LANES + 1, LANES),
                                   lambda a, b: a != b), lambda x: x)).alias("apart"),
    )), lambda x: (x["used"] <= LANES * 3 // 4) | (x["k"] == LEVELS - 1))
    share = F.aggregate(F.slice(levels, 1, 1), F.lit(0.0), lambda a, x: F.when(x["used"] > 0, F.greatest(
        F.lit(0.0), 1 - F.log(1 - F.least(x["apart"] / LANES, F.lit(1 - 0.5 / LANES)))
        / F.log(1 - F.least(x["used"] / LANES, F.lit(1 - 0.5 / LANES))))).otherwise(a))
    return F.when((wide == other_wide) & (fine == other_fine), 1.0).otherwise(share)


def with_next(df: DataFrame, columns: list[str], order: str = "doc_id", tie: str = "text") -> DataFrame:
    """Adds ``next_{column}`` from the row that follows by ``order`` (nulls first, ties by ``tie``); the first follows the last.

    Rows are dealt into ranges of the order with about equal numbers of rows. Each range also gets copies of the next
    one's first rows, so that no window spans more than a range.
    """
    spark = df.sparkSession
    n = min(2000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)))
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>")
    rows = df.withColumns({"_key": key, "_range": F.size(F.filter(cuts, lambda c: c <= key)), "_copy": F.lit(False)})
    firsts = sorted(tuple(r) for r in rows.groupBy("_range").agg(F.min("_key")).collect())  # at most ``n`` rows
    before = [x for i, (_, first) in enumerate(firsts) for x in (F.lit(first), F.lit(firsts[i - 1][0]))]
    if before:
        goes_to = F.create_map(*before)[F.col("_key")]
        rows = rows.unionByName(rows.withColumns({"_range": goes_to, "_copy": F.lit(True)}).where("_range IS NOT NULL"))
    w = W.partitionBy("_range").orderBy("_copy", "_key", tie)
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("NOT _copy").drop("_key", "_range", "_copy")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as much of the beginning of the following one."""
    m = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - m), F.substring(following, F.lit(1), m))


def op6_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(with_fingerprint(docs, "text", "own"), ["text", "own_wide", "own_fine"])
    both = both.withColumns({"n_chars": F.length("text").cast("long"), "edit": edited(F.col("text"), F.col("next_text"))})
    both = with_fingerprint(both, "edit", "edit")
    c = F.col
    return both.select(
        "doc_id", "n_chars", F.sha2("edit", 256).alias("edited_sha256"),
        as_text(c("own_wide"), c("own_fine")).alias("fingerprint"), as_text(c("edit_wide"), c("edit_fine")).alias("edited_fingerprint"),
        likeness(c("own_wide"), c("own_fine"), c("edit_wide"), c("edit_fine")).alias("near_edited"),
        likeness(c("own_wide"), c("own_fine"), c("next_own_wide"), c("next_own_fine")).alias("near_next"),
    )
