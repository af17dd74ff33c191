"""From spool lines to batches in the store, as one micro-batch job."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracehold import conventions as cv
from tracehold.operators.governance import mark_unknown, stamp, within_budget
from tracehold.session import cut, nothing
from tracehold.sources.batches import nesting, parse_lines
from tracehold.sources.spool import counters, read_spool

_SPENT, _COUNTS = "run string, bytes bigint", "lines bigint, malformed bigint, oversized bigint, blank bigint, ignored bigint, over_budget bigint"
_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ship_id(received: dt.datetime, seed: str) -> str:
    """A 26-character id that sorts by time and is the same for the same seed and time."""
    ms = int(received.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    n = (ms << 80) | (int.from_bytes(hashlib.sha256(seed.encode()).digest()[:10], "big"))
    out = ""
    for _ in range(26):
        out, n = _DIGITS[n & 31] + out, n >> 5
    return out


def _ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(f"{schema}, batch string").parquet(path) if there else nothing(spark, f"{schema}, batch string")


def _kept(lines: DataFrame, good: DataFrame, manifests: DataFrame, ledger: str, seed: str) -> DataFrame:
    """The lines that fit their run's budget after all earlier batches, marked where the run is over it."""
    spark, columns = lines.sparkSession, ["line", "class", "name", "signal", "over_budget"]
    spent = _ledger(spark, f"{ledger}/spent", _SPENT).filter(F.col("batch") != seed).groupBy("run").agg(F.sum("bytes").alias("spent"))
    # lines of a file come in order inside a block, and blocks by where they begin
    runs = good.filter("class = 'run'").select("line", "class", "name", "signal", "file", "bytes", F.col("name").alias("run"), F.struct("block", F.monotonically_increasing_id()).alias("offset"))
    judged = cut(within_budget(runs, manifests.select("run", "budget"), spent=spent), "budgets")
    judged.groupBy("run").agg(F.sum("bytes").alias("bytes")).write.mode("overwrite").parquet(f"{ledger}/spent/batch={seed}")
    over = judged.agg(F.count_if(~F.col("kept")).alias("over_budget"))
    counters(lines).unionByName(over, allowMissingColumns=True).write.mode("overwrite").parquet(f"{ledger}/counts/batch={seed}")
    rest = good.filter("class IS DISTINCT FROM 'run'").withColumn("over_budget", F.lit(False))
    return judged.filter("kept").select(*columns).unionByName(rest.select(*columns))


def shipped(spark: SparkSession, ledger: str) -> DataFrame:
    """One row: how many lines all batches of a ledger held, and how many of them were passed over, and why."""
    names = [f.split()[0] for f in _COUNTS.split(", ")]
    return _ledger(spark, f"{ledger}/counts", _COUNTS).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def write_batch(lines: DataFrame, manifests: DataFrame, root: str, collector_id: str, seed: str, instance: str | None = None,
                received: dt.datetime | None = None, registry: DataFrame | None = None, ledger: str | None = None) -> list[str]:
    """Stamp some spool lines and store them as gzip JSONL, a set of files a signal; empty signals have none.

    ``registry``: resources of tools it does not have are marked. ``ledger``: a folder that keeps, for each
    batch by its ``seed``, what every run's lines took and what was passed over, so budgets hold over all
    batches; a batch that is repeated replaces its own entries and counts once.

    Files are written beside the store's folders and then moved to their keys, so a reader never sees
    half a batch. The driver moves one file per task of the micro-batch.
    """
    spark = lines.sparkSession
    now = received or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    keys: list[str] = []
    good = lines.filter("status = 'ok'")
    if ledger is not None:
        good = _kept(lines, good, manifests, ledger, seed)
    good = good.persist()
    try:
        depth = nesting(good)
        by_run = F.col("class").eqNullSafe("run")
        sides = [(r.signal, r.by_run) for r in good.select("signal", by_run.alias("by_run")).distinct().collect()]
        for signal in sorted({s for s, _ in sides}):
            column = cv.RESOURCE_COLUMN[signal]
            lines_of = good.filter(F.col("signal") == signal).select("line", "class", "name", *(["over_budget"] if ledger is not None else []))
            # Only lines of runs are joined with manifests: the others stay in the pieces they come in.
            out = None
            for run in sorted(run for s, run in sides if s == signal):
                raw = parse_lines(lines_of.filter(by_run if run else ~by_run), signal, whole=True, depth=depth)
                one = stamp(raw, manifests if run else None, collector_id, instance, F.lit(now.replace(tzinfo=dt.timezone.utc)))
                out = one if out is None else out.unionByName(one)
            out = out if registry is None else mark_unknown(out, registry)
            staging = f"{root}/.staging/{seed}-{signal}"
            out.select(F.to_json(F.struct(column)).alias("value")).write.mode("overwrite").option("compression", "gzip").text(staging)
            folder = f"{signal}/{now:%Y/%m/%d/%H}/{collector_id}"
            fs.mkdirs(path(f"{root}/{folder}"))
            files = sorted(s.getPath().getName() for s in fs.listStatus(path(staging)) if s.getPath().getName().endswith(".gz"))
            for i, name in enumerate(files):
                key = f"{folder}/{ship_id(now, f'{seed}/{signal}/{i}')}_stream.{seed}-{i}-{i + 1}.jsonl.gz"
                fs.rename(path(f"{staging}/{name}"), path(f"{root}/{key}"))
                keys.append(key)
            fs.delete(path(staging), True)
    finally:
        good.unpersist()
    return keys


def ship_stream(spark: SparkSession, spool: str, root: str, manifests: DataFrame, collector_id: str, checkpoint: str,
                instance: str | None = None, max_bytes: int = cv.MAX_OBJECT_BYTES, every: str | None = "15 seconds",
                registry: DataFrame | None = None, ledger: str | None = None) -> StreamingQuery:
    """Ship a spool's closed files by age or size. Budgets and losses are kept in ``ledger``, beside the
    checkpoint unless it is given. The checkpoint commits a file only once its batch is
    stored, so a crash ships it again and the readers' deduplication counts it once."""
    lines = read_spool(spark, spool, streaming=True, max_bytes_per_trigger=max_bytes)

    ledger = ledger or f"{checkpoint}-ledger"

    def one(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, manifests, root, collector_id, f"b{batch_id}", instance, registry=registry, ledger=ledger)
    writer = lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
