"""The named queries over ``spans``, ``logs`` and the rollups, as DataFrame functions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.functions import otel
from tracehold.functions.numeric import exact_sum, money, round_half_away, whole_sum
from tracehold.operators.forest import trace_tree
from tracehold.operators.median import median_of_counts
from tracehold.session import cut, utc


def in_window(since: dt.datetime, until: dt.datetime, time: str = "time") -> Column:
    return (F.col(time) >= F.lit(utc(since))) & (F.col(time) < F.lit(utc(until)))


def matching(lane: str = "", labels: Sequence[str] = ()) -> Column:
    keep = otel.labels_match(F.col("labels"), labels) if labels else F.lit(True)
    return keep & (F.col("lane") == lane) if lane else keep


def run_spans(spans: DataFrame, since, until, lane="", labels=(), c: cv.Conventions = cv.DEFAULT) -> DataFrame:
    return spans.filter((F.col("name") == c.run_span) & in_window(since, until) & matching(lane, labels))


def tokens(key: str) -> Column:
    return otel.attr(F.col("attributes"), key)


def newest_rows(df: DataFrame, newest: int | None) -> DataFrame:
    """The first rows of an ordered answer; all of them with None."""
    return df if newest is None else df.limit(newest)


def runs(spans: DataFrame, since, until, lane="", labels=(), c: cv.Conventions = cv.DEFAULT) -> DataFrame:
    """Runs by outcome for each lane.

    One pass counts by (lane, outcome, duration) and is written out; totals and medians both read
    that small table, so the spans are scanned and deduplicated once.
    """
    keys = ["lane", "outcome"]
    by_value = cut(run_spans(spans, since, until, lane, labels, c)
                .select(F.coalesce("lane", F.lit(cv.BY_HAND)).alias("lane"),
                        F.coalesce("outcome", F.lit(cv.NO_OUTCOME)).alias("outcome"), "duration_ms", "cost_usd", "time")
                .groupBy(*keys, "duration_ms")
                .agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("cost_usd")).alias("cost"), F.max("time").alias("last")), "runs")
    totals = by_value.groupBy(*keys).agg(F.sum("n").alias("runs"), F.try_sum("cost").alias("cost"), F.max("last").alias("last"))
    medians = median_of_counts(by_value, keys, "duration_ms", "n")
    return (totals.join(medians, keys, "left")
            .select("lane", "outcome", "runs", round_half_away(F.col("median") / 1000, 1).alias("median_s"),
                    money(F.col("cost")).alias("cost_usd"), "last")
            .orderBy("lane", F.desc("runs"), "outcome"))


def runs_from_rollups(rollups: DataFrame, lane: str = "") -> DataFrame:
    """The same over whole days. A median cannot be rolled up, so it is NULL."""
    rows = rollups.filter(F.col("lane") == lane) if lane else rollups
    return (rows.groupBy(F.coalesce("lane", F.lit(cv.BY_HAND)).alias("lane"),
                         F.coalesce("outcome", F.lit(cv.NO_OUTCOME)).alias("outcome"))
            .agg(F.sum("runs").alias("runs"), F.lit(None).cast("double").alias("median_s"),
                 money(exact_sum(F.col("cost_usd"))).alias("cost_usd"), F.max("day").alias("last"))
            .orderBy("lane", F.desc("runs"), "outcome"))


def recent(spans: DataFrame, since, until, lane="", labels=(), c: cv.Conventions = cv.DEFAULT, newest: int | None = cv.NEWEST) -> DataFrame:
    """The newest runs (all with ``newest=None``); sorted and cut per partition before anything is gathered."""
    return newest_rows(run_spans(spans, since, until, lane, labels, c)
            .select("time", F.coalesce("lane", F.lit(cv.BY_HAND)).alias("lane"), F.col("item_key").alias("item"), "actor",
                    F.coalesce("outcome", F.lit(cv.NO_OUTCOME)).alias("outcome"), "model",
                    round_half_away(F.col("duration_ms") / 1000, 1).alias("duration_s"),
                    round_half_away(F.col("cost_usd"), 4).alias("cost_usd"), "trace_id")
            .orderBy(F.desc_nulls_last("time"), "trace_id"), newest)


def items(spans: DataFrame, since, until, lane="", labels=(), newest: int | None = cv.NEWEST) -> DataFrame:
    """The items seen lately with their last outcome."""
    rows = spans.filter(F.col("item_key").isNotNull() & in_window(since, until) & matching(lane, labels))
    # Count distinct steps and traces in two levels, so one item's rows spread over its steps and traces.
    part = rows.groupBy("item_key", "step_id", "trace_id").agg(
        F.min("lane").alias("lane"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"),
        F.max(F.when(F.col("outcome").isNotNull(), F.struct("time", "span_id", "outcome"))).alias("latest"))
    seen = part.groupBy("item_key").agg(
        F.min("lane").alias("lane"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.count_distinct("step_id").alias("steps"), F.count_distinct("trace_id").alias("traces"),
        F.max("latest").alias("latest"))
    return newest_rows(seen.select(F.col("item_key").alias("item"), "lane", "first_seen", "last_seen", "steps", "traces",
                        F.col("latest.outcome").alias("last_outcome"))
            .orderBy(F.desc_nulls_last("last_seen"), "item"), newest)


def item(spans: DataFrame, logs: DataFrame, key: str, since, until, labels=()) -> DataFrame:
    """One item's spans and events in order."""
    mine = (F.col("item_key") == key) & in_window(since, until) & matching("", labels)
    s = spans.filter(mine).select("time", F.lit("span").alias("record"), "name", "service", "actor", "outcome",
                                  round_half_away(F.col("duration_ms"), 1).alias("duration_ms"), "step_id", "trace_id", "span_id")
    e = logs.filter(mine & F.col("event").isNotNull()).select(
        "time", F.lit("event").alias("record"), F.col("event").alias("name"), "service", "actor", "outcome",
        F.lit(None).cast("double").alias("duration_ms"), "step_id", "trace_id", "span_id")
    return s.union(e).orderBy(F.asc_nulls_last("time"), F.desc("record"), F.asc_nulls_last("name"), "span_id")


def trace(spans: DataFrame, trace_id: str, since, until) -> DataFrame:
    """One trace as a tree, depth first, siblings by time."""
    rows = spans.filter((F.col("trace_id") == trace_id.lower()) & in_window(since, until))
    return (trace_tree(rows)
            .orderBy("path", "span_id")
            .select("time", "depth", "name", "service", "actor", "kind", "status", "outcome",
                    round_half_away(F.col("duration_ms"), 1).alias("duration_ms"), "span_id", "parent_span_id"))


def cost(spans: DataFrame, since, until, lane="", labels=(), c: cv.Conventions = cv.DEFAULT) -> DataFrame:
    """Runs, cost and tokens by model."""
    return (run_spans(spans, since, until, lane, labels, c)
            .groupBy(F.coalesce("model", F.lit(cv.NO_MODEL)).alias("model"))
            .agg(F.count(F.lit(1)).alias("runs"), money(exact_sum(F.col("cost_usd"))).alias("cost_usd"),
                 whole_sum(tokens(c.input_tokens)).alias("input_tokens"), whole_sum(tokens(c.output_tokens)).alias("output_tokens"))
            .orderBy(F.desc_nulls_last("cost_usd"), "model"))


def cost_from_rollups(rollups: DataFrame, lane: str = "") -> DataFrame:
    rows = rollups.filter(F.col("lane") == lane) if lane else rollups
    return (rows.groupBy(F.coalesce("model", F.lit(cv.NO_MODEL)).alias("model"))
            .agg(F.sum("runs").alias("runs"), money(exact_sum(F.col("cost_usd"))).alias("cost_usd"),
                 whole_sum(F.col("input_tokens")).alias("input_tokens"), whole_sum(F.col("output_tokens")).alias("output_tokens"))
            .orderBy(F.desc_nulls_last("cost_usd"), "model"))
