"""Daily and monthly rollups of runs and metrics, by the day their records were received.

The same functions write a rollup and answer a day that has none yet, so the two cannot differ.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.functions import otel
from tracehold.functions.numeric import exact_sum, full_sum, whole_sum

RUN_KEYS = ["lane", "model", "outcome", "harness", "repo"]
METRIC_KEYS = ["name", "unit", "type", "temporality", "service", "attributes"]


def run_rollup(spans: DataFrame, day: str = "day", c: cv.Conventions = cv.DEFAULT) -> DataFrame:
    """Run totals of each receipt day by lane, model, outcome, harness and repo."""
    tokens = lambda key: whole_sum(otel.attr(F.col("attributes"), key))
    return (spans.filter(F.col("name") == c.run_span).groupBy(F.col(day).alias("day"), *RUN_KEYS).agg(
        F.count(F.lit(1)).alias("runs"), exact_sum(F.col("cost_usd")).cast("double").alias("cost_usd"),
        tokens(c.input_tokens).alias("input_tokens"), tokens(c.output_tokens).alias("output_tokens"),
        full_sum(F.col("duration_ms")).alias("duration_ms")))


def series_resource(resource: Column, series_key: str, c: cv.Conventions = cv.DEFAULT) -> Column:
    """What of the resource tells two series apart. The transport stamps differ from line to line of
    one series, so they are left out unless ``series_key='raw'``."""
    if series_key == "raw":
        return resource
    if series_key != "logical":
        raise ValueError(f"series_key {series_key!r}")
    return F.filter(resource, lambda a: ~F.coalesce(a["k"].isin(*c.transport), F.lit(False)))


def metric_rollup(points: DataFrame, day: str = "day", series_key: str = "logical", c: cv.Conventions = cv.DEFAULT) -> DataFrame:
    """Metric totals of each receipt day by attribute set: a delta series adds its sum, a cumulative
    one its last value, a gauge nothing. ``count`` is always added, as the store's rollups always
    did, so a cumulative histogram's count is the sum of its readings."""
    last = F.max(F.when(F.col("time").isNotNull() & F.col("value").isNotNull(), F.struct("time", "value"))).alias("last")
    series = (points.withColumn("_series", series_resource(F.col("resource"), series_key, c))
              .groupBy(F.col(day).alias("day"), *METRIC_KEYS, "_series", "start_time")
              .agg(last, full_sum(F.col("value")).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"),
                   full_sum(F.col("count")).alias("count"), F.count(F.lit(1)).alias("points")))
    adds = (F.when(F.col("type") == "gauge", None)
            .when(F.col("temporality") == "cumulative", F.col("last.value").cast("double")).otherwise(F.col("sum")))
    return series.groupBy("day", *METRIC_KEYS).agg(
        full_sum(adds).alias("total"), full_sum(F.col("count")).alias("count"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("points").alias("points"))


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def monthly_runs(daily: DataFrame) -> DataFrame:
    return daily.groupBy(month_of(F.col("day")).alias("day"), *RUN_KEYS).agg(
        F.sum("runs").alias("runs"), exact_sum(F.col("cost_usd")).cast("double").alias("cost_usd"),
        whole_sum(F.col("input_tokens")).alias("input_tokens"), whole_sum(F.col("output_tokens")).alias("output_tokens"),
        full_sum(F.col("duration_ms")).alias("duration_ms"))


def monthly_metrics(daily: DataFrame) -> DataFrame:
    """A delta metric's days are added; of a cumulative metric the last day counts."""
    last = F.max(F.when(F.col("total").isNotNull(), F.struct("day", "total")))["total"]
    return (daily.withColumn("_month", month_of(F.col("day"))).groupBy("_month", *METRIC_KEYS).agg(
        last.alias("_last"), full_sum(F.col("total")).alias("_sum"),
        full_sum(F.col("count")).alias("count"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("points").alias("points"))
        .select(F.col("_month").alias("day"), *METRIC_KEYS,
                F.when(F.col("temporality") == "cumulative", F.col("_last")).otherwise(F.col("_sum")).alias("total"),
                "count", "min", "max", "points"))


ROLL = {"runs": run_rollup, "metrics": metric_rollup}
ROLL_MONTH = {"runs": monthly_runs, "metrics": monthly_metrics}


def month_start(d: dt.date) -> dt.date:
    return d.replace(day=1)


def next_month(d: dt.date) -> dt.date:
    return (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1)


def window_days(since: dt.datetime, until: dt.datetime) -> list[dt.date]:
    """The whole days a window touches."""
    d, out = since.date(), []
    while dt.datetime.combine(d, dt.time()) < until:
        out.append(d)
        d += dt.timedelta(days=1)
    return out


def cover(since: dt.datetime, until: dt.datetime, months: Iterable[dt.date], days: Iterable[dt.date]) -> tuple[list, list, list]:
    """Which months, days and open days answer a window, each day once: a month's rollup where the
    window holds all of it, else the day's, else the day's own records."""
    have_months, have_days = set(months), set(days)
    use_months, use_days, open_days = [], [], []
    d = since.date()
    while dt.datetime.combine(d, dt.time()) < until:
        nxt = next_month(d)
        if d.day == 1 and d in have_months and dt.datetime.combine(nxt, dt.time()) <= until:
            use_months.append(d)
            d = nxt
            continue
        (use_days if d in have_days else open_days).append(d)
        d += dt.timedelta(days=1)
    return use_months, use_days, open_days


def spliced(kind: str, monthly: DataFrame, daily: DataFrame, records: DataFrame, since: dt.datetime, until: dt.datetime,
            months: Iterable[dt.date], days: Iterable[dt.date], day: str = "day") -> DataFrame:
    """One relation for a long window out of its three sources. Every filter is a list of days, so
    each source prunes to its partitions."""
    m, d, o = cover(since, until, months, days)
    pick = lambda df, col, wanted: df.filter(F.col(col).isin(wanted) if wanted else F.lit(False))
    out = pick(monthly, "day", m).unionByName(pick(daily, "day", d), allowMissingColumns=True)
    return out.unionByName(ROLL[kind](pick(records, day, o), day), allowMissingColumns=True)
