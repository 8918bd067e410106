"""URL filter: rules first, then gradient-boosted trees over lexical features.

The trees learn from the URLs that the rules label. Everything is DataFrame code; nothing runs in Python on executors.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.common import stored, table

#: The trees see at most about this many labelled URLs; the suffix statistics count all of them.
TRAIN_ROWS, TREES, DEPTH = 50_000, 12, 4


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with its subdomains below a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    bits = F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0),
        lambda a, c: F.when(c == "", a).otherwise(
            a - (n - F.length(F.replace(text, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(text, c, F.lit("")))) / n)),
    )
    return F.when(n > 0, bits).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features; null counts as the empty URL."""
    url = F.coalesce(url, F.lit(""))
    size = lambda c: F.length(c).cast("double")
    count = lambda c, what: F.regexp_count(c, F.lit(what)).cast("double")
    return {
        "length": size(url), "host_length": size(host), "path_length": size(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
        "labels": count(host, r"[^.]+"), "hyphens": count(host, "-"),
        "digits": F.when(F.length(url) > 0, count(url, "[0-9]") / size(url)).otherwise(0.0),
        "host_digits": count(host, "[0-9]"), "entropy": entropy(url), "host_entropy": entropy(host),
        "parameters": F.when(F.locate("?", url) > 0, count(F.regexp_extract(url, r"\?([^#]*)", 1), "&") + 1).otherwise(0.0),
        "fragment": (F.locate("#", url) > 0).cast("double"), "secure": F.startswith(url, F.lit("https")).cast("double"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Suffixes whose labelled URLs are counted: top level, last two host labels, path's first part, file ending."""
    return {
        "tld": F.regexp_extract(host, r"([^.]*)$", 1), "site": F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1),
        "section": F.regexp_extract(path, r"^/([^/]*)/", 1), "ending": F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,5})$", 1),
    }


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` of every URL.

    A rule that fits gives the verdict; else the trees do (block at 0.5 or more). If the rules label no URL, or all the
    same way, there is nothing to learn: the other URLs are allowed with the score of the labelled ones' share of blocks.
    Null URLs have empty host and path. Repeated rows give one row each, columns besides the two are not read.
    """
    base = pages.select(F.col(key), F.col(url).alias("_url"))
    host, path = url_parts(F.col("_url"))
    base = base.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": verdict} | suffixes(F.col("host"), F.col("path")))
    base = base.withColumns(features(F.col("_url"), F.col("host"), F.col("path")))
    names = [*features(F.lit(""), F.lit(""), F.lit("")), *(f"{s}_share" for s in suffixes(F.lit(""), F.lit("")))]
    base = stored(base, "url-features")
    known = base.where("ruled IS NOT NULL").groupBy().agg(
        F.count("*").alias("n"), F.sum((F.col("ruled") == "block").cast("long")).alias("blocks")).first()
    n, blocks = known["n"], known["blocks"] or 0
    prior = blocks / n if n else 0.0
    for s in suffixes(F.lit(""), F.lit("")):
        seen = base.where("ruled IS NOT NULL").groupBy(s).agg(
            ((F.sum((F.col("ruled") == "block").cast("double")) + 20 * prior) / (F.count("*") + 20)).alias(f"{s}_share"))
        base = base.join(seen, s, "left").fillna(prior, f"{s}_share")
    if 0 < blocks < n:
        rows = base.where("ruled IS NOT NULL").select(*names, (F.col("ruled") == "block").cast("double").alias("label"), "_url")
        if n > TRAIN_ROWS:
            rows = rows.where(F.pmod(F.xxhash64("_url"), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n))
        model = fit(rows, names)
        base = VectorAssembler(inputCols=names, outputCol="_features").transform(base)
        base = model.transform(base).withColumn("block_score", vector_to_array("probability")[1])
    else:
        base = base.withColumn("block_score", F.lit(prior))
    by_model = F.when((F.col("block_score") >= 0.5) & F.lit(0 < blocks < n), "block").otherwise("allow")
    return base.select(key, "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "block_score")


def fit(rows: DataFrame, names: list[str]) -> GBTClassificationModel:
    """Boosted trees on a stored sample."""
    sample = stored(rows.select(*names, "label"), "url-sample")
    gbt = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_prediction",
                        maxIter=TREES, maxDepth=DEPTH, seed=7)
    return gbt.fit(VectorAssembler(inputCols=names, outputCol="_features").transform(sample))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge(table(spark, folder, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "block_score")
