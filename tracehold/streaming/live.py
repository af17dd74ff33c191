"""Streams a person watches: the tail, run counters, and units that never ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.operators.flatten import keep_records, records
from tracehold.operators.governance import with_manifest
from tracehold.sources.batches import parse_lines
from tracehold.sources.spool import read_spool

_ABOUT = ("class", "writer", "_lane", "_item")


def tail(spark: SparkSession, spool: str, manifests: DataFrame, service: str | None = None, item: str | None = None,
         streaming: bool = True) -> DataFrame:
    """Records as a spool's files close, with a run's lane and item from its manifest, filtered."""
    lines = with_manifest(read_spool(spark, spool, streaming).filter("status = 'ok'"), manifests).select("line", "signal", *_ABOUT)
    raw = {s: parse_lines(lines.filter(F.col("signal") == s).drop("signal"), s) for s in cv.SIGNALS}
    return keep_records(records(raw["traces"], raw["logs"], raw["metrics"], keep=_ABOUT, writer="writer"), service, item)


def run_counts(spans: DataFrame, watermark: str = "1 hour", c: cv.Conventions = cv.DEFAULT) -> DataFrame:
    """Runs of each hour by lane and outcome, kept up to date; works on a stream and on a table."""
    return (spans.filter(F.col("name") == c.run_span).withWatermark("time", watermark)
            .groupBy(F.window("time", "1 hour").alias("w"), F.coalesce("lane", F.lit(cv.BY_HAND)).alias("lane"),
                     F.coalesce("outcome", F.lit(cv.NO_OUTCOME)).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("runs"))
            .select(F.col("w.start").alias("hour"), "lane", "outcome", "runs"))


def unfinished_stream(marks: DataFrame, grace: str = "1 hour") -> DataFrame:
    """``trace_id, unit, started`` of units without a span from ``grace`` before to ``grace`` after their start.

    ``marks``: trace_id, unit, what (start or span), time. A left outer join of the stream with itself: a start
    waits in the state until the watermark has passed the last time its span may have, so marks may come out of
    order by up to ``grace``. Copies of a mark are dropped first; of several starts of a unit within
    the watermark the first to come counts. Null ids and units are values of their own.
    """
    def of(what: str, at: str, key: tuple[str, ...]) -> DataFrame:
        # Each side's watermark follows all marks, also where the other kind is all that comes: a condition
        # that needs the time is not moved before the watermark, one on ``what`` alone would be.
        rows = marks.select("trace_id", "unit", "what", F.col("time").alias(at)).withWatermark(at, grace)
        return rows.filter(F.when(F.col("what") == what, F.col(at)).isNotNull()).drop("what").dropDuplicatesWithinWatermark([*key])
    starts = of("start", "started", ("trace_id", "unit")).alias("s")
    spans = of("span", "ended", ("trace_id", "unit", "ended")).withColumn("came", F.lit(True)).alias("e")
    wait = F.expr(f"INTERVAL {grace}")
    same = (F.col("s.trace_id").eqNullSafe(F.col("e.trace_id")) & F.col("s.unit").eqNullSafe(F.col("e.unit"))
            & (F.col("ended") >= F.col("started") - wait) & (F.col("ended") <= F.col("started") + wait))
    return starts.join(spans, same, "left_outer").filter("came IS NULL").select("s.trace_id", "s.unit", "started")
