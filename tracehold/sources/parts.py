"""Compacted parts: Parquet read by column name, gated by schema version, masked on the way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracehold import conventions as cv
from tracehold.functions import otel
from tracehold.schemas import TABLE
from tracehold.session import nothing

VERSION_COLUMN = "_schema_version"


class NewerSchema(ValueError):
    """A part written by a later version than this reader knows."""


def check_version(parts: DataFrame) -> None:
    """Refuse parts with a version above ours or not a number. Min/max answer from Parquet statistics."""
    v = F.col(VERSION_COLUMN)
    row = parts.agg(F.max(v.try_cast("int")).alias("newest"),
                    F.max(F.when(v.isNotNull() & v.try_cast("int").isNull(), v)).alias("bad")).first()
    if row.bad is not None or (row.newest or 0) > cv.SCHEMA_VERSION:
        raise NewerSchema(f"schema version {row.bad or row.newest} is newer than {cv.SCHEMA_VERSION}")


def mask_part(df: DataFrame, erased: Sequence[str]) -> DataFrame:
    """Erased people masked in what an older part still holds."""
    if not erased:
        return df
    return df.withColumns({"resource": otel.mask_attrs(F.col("resource"), erased),
                           "attributes": otel.mask_attrs(F.col("attributes"), erased),
                           "actor": otel.mask_actor(F.col("actor"), erased)})


def read_parts(spark: SparkSession, signal: str, paths: Sequence[str], erased: Sequence[str] = (),
               partition_columns: Sequence[str] = (), base: str | None = None, check: bool = True) -> DataFrame:
    """Parts as the signal's table. A column an older part lacks is NULL; unknown columns are not read."""
    fields = list(TABLE[signal].fields) + [T.StructField(VERSION_COLUMN, T.StringType())]
    fields += [T.StructField(p, T.StringType()) for p in partition_columns]
    schema = T.StructType(fields)
    if not paths:
        return nothing(spark, schema).drop(VERSION_COLUMN)
    reader = spark.read.schema(schema)
    if base:
        reader = reader.option("basePath", base)
    df = reader.parquet(*paths)
    if check:
        check_version(df)
    return mask_part(df.drop(VERSION_COLUMN), erased)


def write_sorted(df: DataFrame, path: str, by: Sequence[str], partition: Sequence[str], mode: str = "append") -> None:
    """Zstd Parquet, a partition's files sized by Spark's rebalance and sorted for row-group skipping.

    Rebalancing splits a hot hour over several tasks and joins small ones, so no hour is one task's work.
    """
    out = df.withColumn(VERSION_COLUMN, F.lit(str(cv.SCHEMA_VERSION)))
    (out.hint("rebalance", *partition).sortWithinPartitions(*partition, *by).write.mode(mode)
     .option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path))
