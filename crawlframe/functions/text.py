"""Text cleaning, trigram similarity and identifier columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.functions.lang import WS, strip


def collapse(value: Column, max_len: int = 10000) -> Column:
    """Collapse white space, trim, cut to ``max_len``; empty becomes null."""
    squeezed = strip(F.regexp_replace(value, f"[{WS}]+", " "))
    return F.nullif(F.substring(squeezed, 1, max_len), F.lit(""))


def trigrams(value: Column) -> Column:
    """Trigram set of a text: lower-cased words, two blanks in front and one behind."""
    words = F.filter(
        F.array_distinct(F.split(F.lower(value), r"[^\p{L}\p{N}]+")), lambda w: w != ""
    )
    grams = F.transform(
        F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" "))),
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(grams))


def set_similarity(shared: Column, left: Column, right: Column) -> Column:
    """Shared over united size; 0 if both sets are empty."""
    union = left + right - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def similarity(left: Column, right: Column) -> Column:
    """Similarity of two trigram arrays."""
    return set_similarity(F.size(F.array_intersect(left, right)), F.size(left), F.size(right))


def trace_context(trace_id: Column) -> Column:
    """struct(trace, span) as hex, or null if the id is short or not hexadecimal."""
    padded = F.substring(F.rpad(F.replace(trace_id, F.lit("-"), F.lit("")), 32, "0"), 1, 32)
    ok = (F.length(trace_id) >= 16) & padded.rlike("^[0-9A-Fa-f]{32}$")
    return F.when(
        ok, F.struct(F.lower(padded).alias("trace"), F.lower(F.right(padded, F.lit(16))).alias("span"))
    )
