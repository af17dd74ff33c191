"""Exact grouped medians that survive a group holding a third of all rows.

``percentile`` keeps every distinct value of a group in one task's buffer. Here the input is first
counted by value, which combines before the shuffle; both later steps read that one exchange. The
counts are then bucketed by a monotone function of the value, which is a histogram of bounded size;
a running total over it names the bucket the middle ranks fall in; and only the values inside that
bucket, a slice of a few millionths of the value's own size, are ranked. No buffer holds a group, and no value is
sampled or approximated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_DOUBLING = 1 << 18


def _bucket(v: Column) -> Column:
    """Order-preserving: values in one bucket differ by less than three millionths."""
    size = F.floor(F.log2(F.abs(v)) * BUCKETS_PER_DOUBLING).cast("bigint") + F.lit(1100 * BUCKETS_PER_DOUBLING)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("bigint"))


def _holds(rank: str, upto: Column, n: Column) -> Column:
    return (upto > F.col(rank)) & (upto - n <= F.col(rank))


def median_of_counts(counts: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """``keys, median`` from one row per (keys, value) with its count ``n``. NULL values do not count."""
    rows = counts.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), F.col(n).alias("_n")).withColumn("_b", _bucket(F.col("_v")))
    group = Window.partitionBy(*keys)
    middle = (rows.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
              .withColumn("_upto", F.sum("_bn").over(group.orderBy("_b")))
              .withColumn("_total", F.sum("_bn").over(group))
              .withColumn("_low", F.floor((F.col("_total") - 1) / 2)).withColumn("_high", F.floor(F.col("_total") / 2))
              .filter(_holds("_low", F.col("_upto"), F.col("_bn")) | _holds("_high", F.col("_upto"), F.col("_bn")))
              .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_mb"),
                      (F.col("_upto") - F.col("_bn")).alias("_before"), "_low", "_high"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_b") == F.col("_mb")]
    inside = rows.join(middle, on).select(*keys, "_v", "_n", "_b", "_before", "_low", "_high")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    return (inside.withColumn("_upto", upto).groupBy(*keys).agg(
        ((F.max(F.when(_holds("_low", F.col("_upto"), F.col("_n")), F.col("_v")))
          + F.max(F.when(_holds("_high", F.col("_upto"), F.col("_n")), F.col("_v")))) / F.lit(2.0)).alias("median")))


def grouped_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The exact median of ``value`` for each combination of ``keys``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return median_of_counts(counts, keys, value, "_c")
