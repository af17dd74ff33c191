"""Recent records, each once, kept as they arrive: the hot tables and the queries on them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracehold import conventions as cv
from tracehold.operators.dedupe import new_records, one_per_record
from tracehold.operators.flatten import flatten
from tracehold.plans import catalogue
from tracehold.plans.engine import LONG_RANGE, QUERIES, Engine
from tracehold.plans.store import Store, window_hours
from tracehold.schemas import TABLE
from tracehold.session import nothing, utc
from tracehold.sources.batches import parse_lines
from tracehold.sources.keys import batch_hour

NO_HOUR = "none"
_FILLED = "filled"


def feed(spark: SparkSession, root: str, signal: str, max_files: int = 256) -> DataFrame:
    """A signal's batch lines as they land. The stream's own file log remembers what was read, so a
    batch that lands late in an old hour is seen too; anything not of a batch's exact shape is not."""
    lines = (spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.jsonl.gz").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
             .format("text").load(f"{root}/{signal}").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")))
    return lines.filter(batch_hour(F.substring_index("file", "/", -7), signal).isNotNull())


def hot_table(spark: SparkSession, hot: str, signal: str, hours: Sequence[str] | None = None) -> DataFrame:
    """A hot table, or some of its event hours."""
    schema = T.StructType([*TABLE[signal].fields, T.StructField("hour", T.StringType())])
    path = f"{hot}/{cv.TABLES[signal]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return nothing(spark, schema)
    df = spark.read.schema(schema).parquet(path)
    return df.filter(F.col("hour").isin(list(hours))) if hours is not None else df


def _held_since(spark: SparkSession, hot: str, signal: str) -> dt.datetime | None:
    """From which event time on a hot table is whole; None before its first fill."""
    path = f"{hot}/{_FILLED}/{cv.TABLES[signal]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema("since timestamp_ntz").parquet(path).agg(F.min("since")).first()[0]


def _recent(rows: DataFrame, since: dt.datetime) -> DataFrame:
    """Each record of the window once, with its event ``hour``."""
    rows = rows.filter(F.col("time").isNull() | (F.col("time") >= F.lit(utc(since))))
    return one_per_record(rows).withColumn("hour", F.coalesce(F.date_format("time", "yyyy-MM-dd-HH"), F.lit(NO_HOUR)))


def fill(store: Store, hot: str, signal: str, window: dt.timedelta, now: dt.datetime | None = None) -> None:
    """Add what a hot table lacks of the store's records: those of compacted parts, whose batches may be
    gone, and those of batches that no part covers. Run before a stream starts, it makes the table whole
    however long the stream was away; run again after a failure, it adds what is still missing. A strict
    read: a storage fault fails it. From then on the table answers for the window's event times."""
    spark, at = store.spark, now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    since = at - window
    copies = store.copies(signal, store.state(signal, window_hours(since, at)), strict=True).drop("hour")
    held = hot_table(spark, hot, signal).select("record_id")
    # Rebalanced by hour, as parts are: otherwise each task writes a file for each event hour of a long window.
    fresh = new_records(_recent(copies, since), held).hint("rebalance", "hour")
    fresh.write.mode("append").partitionBy("hour").parquet(f"{hot}/{cv.TABLES[signal]}")
    if _held_since(spark, hot, signal) is None:
        spark.createDataFrame([(since,)], "since timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(f"{hot}/{_FILLED}/{cv.TABLES[signal]}")


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first copy of each record in a batch: a record delivered a million times is thinned before
    it is shuffled to one task's state."""
    for b in batches:
        ids = pa.table({"id": b.column(b.schema.get_field_index("record_id")), "i": pa.array(range(b.num_rows))})
        yield b.take(ids.group_by("id").aggregate([("i", "min")]).column("i_min").combine_chunks())


def hot_stream(spark: SparkSession, root: str, hot: str, signal: str, window: dt.timedelta, checkpoint: str, exact: bool = True,
               erased: Sequence[str] = (), now: dt.datetime | None = None, every: str | None = "5 seconds", max_files: int = 256,
               store: Store | None = None) -> StreamingQuery:
    """Keep a hot table in step with the store.

    ``store``: the table is first filled from its parts and batches, see ``fill``; without it the table holds
    what the stream has read and does not count as whole. ``exact``: each micro-batch is anti-joined with the event hours it touches, so a record is held
    once however late its copy comes. Otherwise Spark's own state removes copies that come within the
    window; its state is bounded by the watermark, and later rows are dropped.
    """
    rows = flatten(signal, parse_lines(feed(spark, root, signal, max_files), signal), erased)
    path = f"{hot}/{cv.TABLES[signal]}"
    span = f"{int(window.total_seconds())} seconds"
    if store is not None:
        if not exact:
            raise ValueError("only an exact table can be filled from the store")
        fill(store, hot, signal, window, now)
    if not exact:
        rows = rows.mapInArrow(_thin, rows.schema)
        fresh = (rows.withWatermark("time", span).dropDuplicatesWithinWatermark(["record_id"])
                 .withColumn("hour", F.coalesce(F.date_format("time", "yyyy-MM-dd-HH"), F.lit(NO_HOUR))))
        w = fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("hour")
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()

    def one(batch: DataFrame, batch_id: int) -> None:
        at = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        recent = _recent(batch, at - window).persist()
        try:
            # A window holds few hours; a copy of a record lies in the same event hour or, for a
            # re-sent span, another one of the window, so the whole held table's ids are compared.
            # A repeated micro-batch finds what its first run has written, and adds nothing twice.
            held = hot_table(spark, hot, signal).select("record_id")
            new_records(recent, held).write.mode("append").partitionBy("hour").parquet(path)
        finally:
            recent.unpersist()
    w = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def evict_hot(spark: SparkSession, hot: str, now: dt.datetime, window: dt.timedelta) -> int:
    """Drop the event hours that ended before the window; returns how many. Reads cut the rest by time."""
    cut = (now - window).strftime("%Y-%m-%d-%H")
    jvm, n = spark.sparkContext._jvm, 0
    for table in cv.TABLES.values():
        p = jvm.org.apache.hadoop.fs.Path(f"{hot}/{table}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = s.getPath().getName()
            if name.startswith("hour=") and name != f"hour={NO_HOUR}" and name.removeprefix("hour=") < cut:
                fs.delete(s.getPath(), True)
                n += 1
    return n


class Hot:
    """Named queries on the hot tables. A window that reaches back before them reads the store, and so does
    every query while one of its tables has not been filled."""

    def __init__(self, engine: Engine, hot: str, window: dt.timedelta):
        self.engine, self.hot, self.window = engine, hot, window
        self.from_store = False

    def _table(self, signal: str) -> DataFrame:
        cut = F.lit(utc(self.engine.now - self.window))
        return hot_table(self.engine.spark, self.hot, signal).drop("hour").filter(F.col("time").isNull() | (F.col("time") >= cut))

    def query(self, name: str, arg: str | None = None, since=None, until=None, lane: str = "", labels: Sequence[str] = ()) -> DataFrame:
        start, end = self.engine.resolve(name, arg, since, until, labels)
        # A minute's grace: a default window and the tables' are measured moments apart.
        filled = [_held_since(self.engine.spark, self.hot, signal) for signal in QUERIES[name].signals]
        self.from_store = (any(f is None or start < f - dt.timedelta(minutes=1) for f in filled) or start < self.engine.now - self.window - dt.timedelta(minutes=1)
                           or (QUERIES[name].rollups and end - start > LONG_RANGE))
        if self.from_store:
            return self.engine.query(name, arg, start, end, lane, labels)
        spans = self._table("traces")
        if name == "trace":
            return catalogue.trace(spans, arg, start, end)
        if name == "item":
            return catalogue.item(spans, self._table("logs"), arg, start, end, labels)
        if name == "items":
            return catalogue.items(spans, start, end, lane, labels)
        return {"runs": catalogue.runs, "recent": catalogue.recent, "cost": catalogue.cost}[name](
            spans, start, end, lane, labels, self.engine.store.c)
