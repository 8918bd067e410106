"""Small Column helpers used by the other function modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters that str.split() and str.strip() treat as white space.
WS_CHARS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a character class.
WS = r"\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def record(**values: Column) -> Column:
    """Struct with fixed field names, also inside nested lambdas."""
    return F.named_struct(*[x for name, v in values.items() for x in (F.lit(name), v)])


def strip(value: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.trim(value, F.lit(WS_CHARS))


def ordered_distinct(values: Column) -> Column:
    """Distinct array elements in first-seen order."""
    return F.array_distinct(values)


def unnest(df: DataFrame, values: Column, *names: str, keep: list | None = None) -> DataFrame:
    """One row per array element as (keep..., [position,] element); ``names`` has one or two names.

    The outer form is used and null rows dropped afterwards. For the inner form the optimizer adds
    a test of the array's size below it, which would compute an expensive array again.
    """
    generator = F.posexplode_outer(values) if len(names) == 2 else F.explode_outer(values)
    rows = df.select(*(keep or []), generator.alias(*names))
    return rows.filter(F.col(names[-1]).isNotNull())


def reusable(build: Callable) -> Callable:
    """Keep the expressions built for a set of column names.

    Building a large expression costs hundreds of calls into the JVM; jobs that run the same
    projection again, such as stream batches, take the finished one.
    """
    built: dict = {}

    @wraps(build)
    def get(*names: str):
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, names)
        if key not in built:
            built[key] = build(*names)
        return built[key]

    return get
