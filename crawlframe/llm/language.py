"""Language identification by words first, then by ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlframe.llm.common import crc_mod, map_rows, small_batches, table

#: Runs of letters (digits and the underscore end a word).
WORD = re.compile(r"[^\W\d_]+")
#: A bounded sample of labelled rows, and a bounded number of words and of n-grams of each length per language.
TRAIN_ROWS, TOP_WORDS, TOP_GRAMS, LONGEST = 8_000, 20_000, 5_000, 5
#: Texts that a worker takes from a batch at once.
AT_ONCE = 250


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between its bounds; a shorter word has none."""
    w = f"<{word}>"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies per language: ``tables[0]`` of words, ``tables[n]`` of character n-grams of length n."""

    languages: list[str]
    tables: list[dict[str, list[float]]]
    keep: int = 100_000
    seen: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def word(self, w: str) -> tuple[float, ...]:
        """Log score of a word in each language, relative to the best one."""
        scores = self.tables[0].get(w) if self.tables else None
        for n in range(LONGEST, 0, -1) if scores is None else ():
            found = [s for g in grams(w, n) if (s := self.tables[n].get(g))]
            if found:
                scores = [sum(x) / len(found) for x in zip(*found, strict=True)]
                break
        if scores is None:
            return (0.0,) * len(self.languages)
        top = max(scores)
        return tuple(s - top for s in scores)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of belief; ``und`` and 0 for null, letterless text or an untrained model.

        The belief is the softmax of the words' mean scores, sharpened by their number up to 20.
        """
        ws = words_of(text) if text else []
        if not self.languages or not any(c.isalpha() for w in ws for c in w):
            return "und", 0.0
        total = [0.0] * len(self.languages)
        for w, n in Counter(ws).items():
            s = self.seen.get(w)
            if s is None:
                if len(self.seen) > self.keep:
                    self.seen.clear()
                s = self.seen[w] = self.word(w)
            for i, x in enumerate(s):
                total[i] += n * x
        scale = min(len(ws), 20) / len(ws)
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        belief = 1 / sum(math.exp((t - total[best]) * scale) for t in total)
        return self.languages[best], belief


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> LanguageModel:
    """Count words and n-grams per language in about ``rows`` labelled documents, chosen by a hash of their text.

    Rows with null text or language are not used. No usable row gives a model that answers ``und``.
    """
    df = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    n = df.count()
    if n > rows:
        df = df.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(1_000_000 * rows / n))

    def count(batch: dict):
        out: Counter = Counter()
        for at in range(0, len(batch["t"]), 200):
            words: dict[str, Counter] = {}
            for t, lg in zip(batch["t"][at:at + 200], batch["l"][at:at + 200], strict=True):
                words.setdefault(lg, Counter()).update(words_of(t))
            for lg, c in words.items():
                for w, k in c.items():
                    out[lg, 0, w] += k
                    for m in range(1, LONGEST + 1):
                        for g in grams(w, m):
                            out[lg, m, g] += k
        keys = list(out)
        return {"l": [k[0] for k in keys], "n": [k[1] for k in keys], "g": [k[2] for k in keys], "c": list(out.values())}

    counted = map_rows(df, count, "l string, n int, g string, c long", 2 * AT_ONCE).groupBy("l", "n", "g").agg(F.sum("c").alias("c"))
    kind = W.partitionBy("l", "n")
    ranked = counted.withColumn("all", F.sum("c").over(kind)).withColumn(
        "r", F.row_number().over(kind.orderBy(F.desc("c"), "g"))
    ).where(F.col("r") <= F.when(F.col("n") == 0, TOP_WORDS).otherwise(TOP_GRAMS))
    model = ranked.select("l", "n", "g", "c", "all").toPandas()
    languages = sorted(set(model["l"]))
    tables: list[dict[str, list[float]]] = [{} for _ in range(LONGEST + 1)]
    floors = [[0.0] * len(languages) for _ in range(LONGEST + 1)]
    place = {lg: i for i, lg in enumerate(languages)}
    for lg, m, total in model[["l", "n", "all"]].drop_duplicates().itertuples(index=False):
        floors[m][place[lg]] = math.log(0.2 / total)
    for lg, m, g, c, total in model.itertuples(index=False):
        tables[m].setdefault(g, list(floors[m]))[place[lg]] = math.log(c / total)
    return LanguageModel(languages, tables)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every row, from its whole text alone. Repeated rows give one row each.

    Of languages with equal scores the first by name wins. A text is held whole, the others of its batch only as Arrow bytes.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(rows: dict):
        found = [sent.value.predict(t) for t in rows["t"]]
        return {key: rows[key], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(F.col(key), F.col(text).alias("t")), work, f"`{key}` {kind}, lang_pred string, score double", AT_ONCE)


def keep_known(df: DataFrame, model: LanguageModel, least: float, text: str = "text") -> DataFrame:
    """The rows whose whole text is in a known language with a belief of ``least`` or more, unchanged.

    Null, empty and letterless texts go; an untrained model keeps nothing.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    small_batches(df.sparkSession)

    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                found = (sent.value.predict(t.as_py()) for t in part.column(at))  # one text at a time as a Python string
                yield part.filter(pa.array([lang != "und" and s >= least for lang, s in found], pa.bool_()))

    return df.mapInArrow(work, df.schema)


def held_out():
    """Documents the model never learns from."""
    return F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, folder, "documents")
    model = train(docs.where(crc_mod("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
