"""Keep one copy of each record.

A ``row_number() = 1`` filter: Spark plans a partial ``WindowGroupLimit`` before the shuffle, so each
map task sends at most one row per key. A record delivered a million times, or a third of all rows
without an id, therefore never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_one(df: DataFrame, key: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    The key's hash leads the sort: comparing two longs settles almost every comparison, where ids
    that share a long prefix would be compared byte by byte.
    """
    w = Window.partitionBy(F.xxhash64(*key), *key).orderBy(*order)
    return df.withColumn("_copy", F.row_number().over(w)).filter("_copy = 1").drop("_copy")


def content_order(df: DataFrame) -> Column:
    """A tiebreak over a row's content, so two different copies in one file resolve the same way."""
    fields = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*[F.col(c) for c in fields])


def one_per_record(df: DataFrame, null_identity: str = "one") -> DataFrame:
    """Each ``record_id`` once, the copy in the lowest file.

    Records without an id count as one record (``null_identity='one'``) or are told apart by their
    content (``'content_hash'``).
    """
    if null_identity == "content_hash":
        key = [F.coalesce(F.col("record_id"), F.concat(F.lit("#"), content_order(df.drop("file"))))]
    elif null_identity == "one":
        key = [F.col("record_id")]
    else:
        raise ValueError(f"null_identity {null_identity!r}")
    return keep_one(df, key, [F.col("file").asc_nulls_last(), content_order(df)])


def combined(batches: DataFrame, parts: DataFrame | None = None, null_identity: str = "one") -> DataFrame:
    """Batches and compacted parts as one table: a batch shipped again after its hour was compacted
    holds records the part already has, so one pass removes the copies of both."""
    rows = batches if parts is None else parts.unionByName(batches, allowMissingColumns=True)
    return one_per_record(rows, null_identity)


def new_records(incoming: DataFrame, held: DataFrame, key: str = "record_id") -> DataFrame:
    """Incoming records that are not held yet. A record without an id is always new."""
    return incoming.join(held.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
