"""Spool folders: who wrote a file, and its complete lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.functions.text import source_name
from tracehold.sources.batches import clean_line, line_signal, line_status

_NAMED = r"^(services|runs)/([A-Za-z0-9][A-Za-z0-9._-]{0,127})/[^/]+\.jsonl\z"
_PLAIN = r"^(factory|local)/[^/]+\.jsonl\z"


def writer(rel: Column) -> Column:
    """``struct<class, name, rel>`` of a spool path, or NULL for anything a reader ignores."""
    folder, name = F.regexp_extract(rel, _NAMED, 1), F.regexp_extract(rel, _NAMED, 2)
    plain = F.regexp_extract(rel, _PLAIN, 1)
    named = F.struct(F.when(folder == "runs", "run").otherwise("service").alias("class"), name.alias("name"),
                     F.concat(folder, F.lit("/"), name).alias("rel"))
    return F.when(folder != "", named).when(plain != "", F.struct(
        plain.alias("class"), F.lit("").alias("name"), plain.alias("rel")))


def is_open(path: Column) -> Column:
    """A file still being appended to; it is read under its closed name."""
    return F.endswith(path, F.lit(".open.jsonl"))


def read_spool(spark: SparkSession, root: str, streaming: bool = False, max_line: int = cv.MAX_LINE_BYTES,
               max_bytes_per_trigger: int | None = None) -> DataFrame:
    """``line, file, block, rel, class, name, writer, source, bytes, status, signal`` of the closed files' lines."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option(
        "ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if streaming:
        reader = reader.schema("value string")
        if max_bytes_per_trigger:
            reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    # Both sides without scheme and authority: a listing may spell them otherwise than the caller.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getRawPath().rstrip("/")
    raw = reader.format("text").load(root).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rel = F.substr(F.regexp_replace("file", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit(len(base) + 2))
    rows = raw.filter(~is_open(F.col("file"))).withColumn("rel", rel).withColumn("w", writer(F.col("rel")))
    line = clean_line(F.col("value"))
    status = F.when(F.col("w").isNull(), "ignored").otherwise(line_status(line, max_line))
    return rows.select(line.alias("line"), "file", "block", "rel", F.col("w.class").alias("class"), F.col("w.name").alias("name"),
                       F.col("w.rel").alias("writer"), source_name(F.col("rel")).alias("source"),
                       (F.octet_length("value") + 1).alias("bytes"), status.alias("status"),
                       F.when(status == "ok", line_signal(line)).alias("signal"))


def counters(lines: DataFrame) -> DataFrame:
    """Losses made visible: one row of counts over a spool read."""
    n = lambda s: F.count_if(F.col("status") == s)
    return lines.agg(n("ok").alias("lines"), n("malformed").alias("malformed"), n("oversized").alias("oversized"),
                     n("blank").alias("blank"), n("ignored").alias("ignored"))
