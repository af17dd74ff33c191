"""Aggregations behind reports: lanes, outcomes, shares, waterfalls, cardinality, retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.functions.numeric import exact_sum, round_half_away
from tracehold.operators.prefix import running_total
from tracehold.session import cut, utc
from tracehold.sources.keys import key_span
from tracehold.sources.spool import is_open


def lane_summary(runs: DataFrame) -> DataFrame:
    """Each lane of a ``runs`` answer: runs, converged, yield, cost, latest, and the first median."""
    n = F.sum("runs")
    good = F.sum(F.when(F.col("outcome") == "converged", F.col("runs")).otherwise(0))
    first = F.min(F.when(F.col("median_s").isNotNull(), F.struct((-F.col("runs")).alias("r"), "outcome", "median_s")))
    return runs.groupBy("lane").agg(
        n.alias("runs"), good.alias("converged"), F.when(n > 0, F.round(good * 100 / n)).alias("yield_pct"),
        F.round(exact_sum(F.col("cost_usd")), 2).cast("double").alias("cost_usd"), F.max("last").alias("last"),
        first["median_s"].alias("median_s"))


def outcome_matrix(runs: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Runs by lane and outcome, a column an outcome. The outcomes are given, so no extra pass finds them."""
    return runs.groupBy("lane").pivot("outcome", list(outcomes)).agg(F.sum("runs")).fillna(0, list(outcomes))


def cost_share(cost: DataFrame) -> DataFrame:
    """Each model's part of the whole cost. The whole is one row, joined on a constant key, so the
    models are never gathered in one task to be added."""
    total = cost.agg(exact_sum(F.col("cost_usd")).cast("double").alias("_all")).withColumn("_one", F.lit(1))
    return (cost.withColumn("_one", F.lit(1)).join(total, "_one")
            .select("model", "cost_usd", round_half_away(F.col("cost_usd") * 100 / F.when(F.col("_all") != 0, F.col("_all")), 4).alias("share_pct")))


def waterfall(tree: DataFrame, keys: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Where each span lies on its trace's time line, as percentages.

    The line's ends are aggregated, which combines before the shuffle, and joined back; a window would
    gather a trace with a third of all spans in one task.
    """
    us = F.unix_micros("time")
    length = F.round(F.coalesce("duration_ms", F.lit(0.0)) * 1000).cast("bigint")
    rows = tree.withColumn("_start", us).withColumn("_len", length)
    ends = rows.groupBy(*keys).agg(F.min("_start").alias("_from"), F.max(F.col("_start") + F.col("_len")).alias("_to"))
    total = F.when(F.col("_to") > F.col("_from"), F.col("_to") - F.col("_from")).otherwise(F.lit(1000))
    left = (F.col("_start") - F.col("_from")) * 100.0 / total
    width = F.least(F.greatest(F.lit(0.3), F.col("_len") * 100.0 / total), 100.0 - left)
    return rows.join(ends, list(keys)).withColumn("left_pct", left).withColumn("width_pct", width).drop("_start", "_len", "_from", "_to")


def cardinality(points: DataFrame, limits: DataFrame) -> DataFrame:
    """Distinct values of each metric attribute against the declared limit.

    ``points``: metric, attr, value. ``limits``: metric, attr, limit. Distinct values are made first, so
    an attribute with a third of all values is spread over its values.
    """
    counts = points.select("metric", "attr", "value").distinct().groupBy("metric", "attr").agg(F.count("value").alias("distinct_values"))
    return counts.join(limits, ["metric", "attr"], "left").withColumn(
        "over", F.coalesce((F.col("limit") > 0) & (F.col("distinct_values") > F.col("limit")), F.lit(False)))


def span_counts(spans: DataFrame) -> DataFrame:
    """Spans of each service by name."""
    return spans.groupBy(F.coalesce(F.nullif("service", F.lit("")), F.lit("(no service.name)")).alias("service"), "name").agg(
        F.count(F.lit(1)).alias("spans"))


def top_names(counts: DataFrame, n: int | None = 20) -> DataFrame:
    """The most frequent names, all of them with ``n=None``."""
    ordered = counts.orderBy(F.desc("count"), "service", "version", "name")
    return ordered if n is None else ordered.limit(n)


def evidence(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int | None = cv.EVIDENCE_ROWS) -> DataFrame:
    """At most ``most`` rows of each check (None: all) and how many more there are. Each map task sends at most
    that many rows of a check; the count is a separate aggregate."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = rows.withColumn("rank", F.row_number().over(w))
    if most is None:
        return kept.withColumn("more", F.lit(0).cast("bigint"))
    kept = kept.filter(F.col("rank") <= most)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return kept.join(sizes, list(keys)).withColumn("more", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


# --- retention ------------------------------------------------------------------------------------
def retention_plan(listing: DataFrame, now: dt.datetime, records: dt.timedelta | None = dt.timedelta(days=7),
                   rollups: dt.timedelta | None = dt.timedelta(days=396), max_bytes: int | None = None) -> DataFrame:
    """``key, size, reason`` of what to delete from ``key, size``.

    First what is older than its kind is kept (``age``), then, while the records left are over
    ``max_bytes``, the oldest unit of records at a time (``size``). Keys of no known shape stay.
    """
    s = listing.withColumn("_s", key_span(F.col("key"))).filter("_s IS NOT NULL").select(
        "key", "size", F.col("_s.start").alias("_from"), F.col("_s.end").alias("_to"), F.col("_s.rollup").alias("_rollup"))
    # The plan looks at the spans three times; the keys are parsed once.
    return plan_by_span(cut(s, "spans"), now, records, rollups, max_bytes)


def plan_by_span(s: DataFrame, now: dt.datetime, records: dt.timedelta | None, rollups: dt.timedelta | None, max_bytes: int | None) -> DataFrame:
    """The same from keys with their span: ``key, size, _from, _to, _rollup``."""
    def older(keep: dt.timedelta | None) -> Column:
        return F.col("_to") < F.lit(utc(now - keep)) if keep else F.lit(False)
    aged = F.when(F.col("_rollup"), older(rollups)).otherwise(older(records))
    by_age = s.filter(aged).select("key", "size", F.lit("age").alias("reason"))
    left = s.filter(~aged & ~F.col("_rollup"))
    if not max_bytes or max_bytes <= 0:
        return by_age
    units = left.groupBy("_from").agg(F.sum("size").alias("_unit"))
    newest = units.withColumn("_age", -F.unix_micros("_from")).withColumn("_all", F.lit(1))
    kept = running_total(newest, ["_all"], ["_age"], "_unit", "_upto")
    drop = kept.filter(F.col("_upto") > max_bytes).select("_from")
    return by_age.unionByName(left.join(drop, "_from").select("key", "size", F.lit("size").alias("reason")))


def eviction_plan(files: DataFrame, max_bytes: int) -> DataFrame:
    """``path, size`` of the oldest closed files to delete until the spool fits. Open files count but
    are never deleted."""
    opened = files.agg(F.sum(F.when(is_open(F.col("path")), F.col("size")).otherwise(0)).alias("_open")).withColumn("_one", F.lit(1))
    closed = files.filter(~is_open(F.col("path"))).withColumn("_age", -F.unix_micros("modified")).withColumn("_all", F.lit(1))
    kept = running_total(closed, ["_all"], ["_age", "path"], "size", "_upto")
    # A file stays only while it, every newer closed file and the open ones fit.
    return (kept.withColumn("_one", F.lit(1)).join(opened, "_one").filter((F.col("_upto") + F.col("_open") > max_bytes) if max_bytes > 0 else F.lit(False))
            .select("path", "size"))


