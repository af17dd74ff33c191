"""Running totals over any number of rows, however they fall into groups.

A window would put a whole group in one task. Here the rows are range-partitioned by group and order,
so a large group spreads over many partitions, and the layout is written down with its partition
numbers. A running total is then the total inside the row's own partition plus the sum of the group's
earlier partitions, which is a table of one row per group and partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehold.session import cut


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, out: str = "upto",
                  total: str | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``size`` over this row and those before it in its group. ``total``
    names a column for the whole group's sum."""
    laid = cut(df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()), "ordered")
    sums = laid.groupBy(*keys, "_pid").agg(F.sum(size).alias("_sum"))
    group = Window.partitionBy(*keys)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(group.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        before = before.withColumn(total, F.sum("_sum").over(group))
    inside = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (laid.withColumn("_in", F.sum(size).over(inside)).join(before.drop("_sum"), [*keys, "_pid"])
            .withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_pid"))
