"""Running values along an order, without putting a whole key into one task.

A key may hold a large share of all rows, even at one instant. Rows are cut into chunks by their position in the order of
(key, time, id), all of about the same number of rows; windows run inside (key, chunk), one summary row per chunk is scanned along
the key, and the carried value is joined back. A key has at most as many summaries as there are partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.session import durable

CHUNK = "_chunk"


def by_position(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add the number of the chunk of each row, ascending along (keys, order); no row of a chunk lies between those of another.

    The chunks are range partitions. They are written once, so that every branch of the scan, and every repeated task, sees the same cuts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id()))


def join_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Attach one summary row to every row of its (key, chunk); null keys included."""
    names = [*keys, CHUNK]
    side = carry.select(*[F.col(n).alias(f"_c_{n}") for n in names],
                        *[c for c in carry.columns if c not in names])
    condition = None
    for n in names:
        same = F.col(n).eqNullSafe(F.col(f"_c_{n}"))
        condition = same if condition is None else condition & same
    return rows.join(side, condition, "left").drop(*[f"_c_{n}" for n in names])


def before(keys: list[str]):
    """Window over the earlier chunks of a key."""
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def count_before(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                 inclusive: bool = False) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key; ``df`` carries a chunk column."""
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    rows = df.withColumn("_v", value.cast("long"))
    carry = (
        rows.groupBy(*keys, CHUNK).agg(F.sum("_v").alias("_s"))
        .withColumn("_carry", F.coalesce(F.sum("_s").over(before(keys)), F.lit(0)))
        .drop("_s")
    )
    local = rows.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return (
        join_carry(local, carry, keys)
        .withColumn(out, F.col("_local") + F.col("_carry"))
        .drop("_v", "_local", "_carry")
    )
