"""Rollups, the item index and long windows on the fixture tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite.registry import query
from tracehold import conventions as cv
from tracehold.plans import catalogue, rollups
from tracehold.plans.store import item_index

DEC = "DECIMAL(38,9)"
DAILY_RUNS = f"""{fx.RUNS_SQL}, daily AS (SELECT time::DATE AS day, lane, model, outcome, harness, repo, count(*) AS runs,
  sum(cost_usd::{DEC})::DOUBLE AS cost_usd, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  sum(duration_ms::{DEC})::DOUBLE AS duration_ms FROM runs GROUP BY ALL)"""
KEY = "day, name, unit, type, temporality, service, k"
# What readings add, by kind of series: the newest of each cumulative run of readings, every delta, no gauge.
SERIES = f"""{fx.POINTS_SQL}, reading AS (SELECT *, received_day AS day FROM points),
 newest AS (SELECT * FROM reading WHERE temporality='cumulative' AND type IS DISTINCT FROM 'gauge' AND time IS NOT NULL AND value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {KEY}, start_time ORDER BY time DESC, value DESC)=1),
 added AS (SELECT {KEY}, value FROM newest UNION ALL
  SELECT {KEY}, value FROM reading WHERE temporality IS DISTINCT FROM 'cumulative' AND type IS DISTINCT FROM 'gauge' UNION ALL
  SELECT DISTINCT {KEY}, NULL FROM reading),
 gain AS (SELECT {KEY}, sum(value::{DEC})::DOUBLE AS total FROM added GROUP BY ALL),
 span AS (SELECT {KEY}, sum(count::{DEC})::DOUBLE AS count, min(value) AS min, max(value) AS max, count(*) AS points FROM reading GROUP BY ALL),
 daily AS (SELECT s.*, g.total FROM span s JOIN gain g ON {" AND ".join(f"s.{c} IS NOT DISTINCT FROM g.{c}" for c in KEY.split(", "))})"""


def received(spark, d):
    return fx.runs(spark, d).withColumn("day", F.to_date("time"))


def daily_runs(spark, d):
    return rollups.run_rollup(received(spark, d))


def daily_metrics(spark, d):
    return rollups.metric_rollup(fx.points(spark, d).withColumnRenamed("received_day", "day"))


def flat_k(df):
    return df.withColumn("k", F.get("attributes.v", F.lit(0)).cast("bigint")).drop("attributes")


@query("daily_run_rollup", f"WITH {DAILY_RUNS} SELECT * FROM daily")
def daily_run_rollup(spark, d):
    return daily_runs(spark, d)


@query("daily_metric_rollup", f"WITH {SERIES} SELECT * FROM daily")
def daily_metric_rollup(spark, d):
    return flat_k(daily_metrics(spark, d))


@query("monthly_run_rollup", f"""WITH {DAILY_RUNS} SELECT date_trunc('month',day)::DATE AS day, lane, model, outcome, harness, repo,
  sum(runs)::BIGINT AS runs, sum(cost_usd::{DEC})::DOUBLE AS cost_usd, sum(input_tokens)::BIGINT AS input_tokens,
  sum(output_tokens)::BIGINT AS output_tokens, sum(duration_ms::{DEC})::DOUBLE AS duration_ms FROM daily GROUP BY ALL""")
def monthly_run_rollup(spark, d):
    return rollups.monthly_runs(daily_runs(spark, d))


@query("monthly_metric_rollup", f"""WITH {SERIES} SELECT date_trunc('month',day)::DATE AS day, name, unit, type, temporality, service, k,
  CASE WHEN temporality='cumulative' THEN arg_max(total, day) FILTER (WHERE total IS NOT NULL) ELSE sum(total::{DEC})::DOUBLE END AS total,
  sum(count::{DEC})::DOUBLE AS count, min(min) AS min, max(max) AS max, sum(points)::BIGINT AS points
  FROM daily GROUP BY date_trunc('month',day)::DATE, name, unit, type, temporality, service, k""")
def monthly_metric_rollup(spark, d):
    return flat_k(rollups.monthly_metrics(daily_metrics(spark, d)))


@query("runs_rollup", f"""WITH {DAILY_RUNS} SELECT coalesce(lane,'{cv.BY_HAND}') AS lane, coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome,
  sum(runs)::BIGINT AS runs, NULL::DOUBLE AS median_s, round(sum(cost_usd::{DEC}),4)::DOUBLE AS cost_usd, max(day) AS last FROM daily GROUP BY 1,2""")
def runs_rollup(spark, d):
    return catalogue.runs_from_rollups(daily_runs(spark, d))


@query("cost_rollup", f"""WITH {DAILY_RUNS} SELECT coalesce(model,'{cv.NO_MODEL}') AS model, sum(runs)::BIGINT AS runs,
  round(sum(cost_usd::{DEC}),4)::DOUBLE AS cost_usd, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens
  FROM daily WHERE lane='1-URGENT' GROUP BY 1""")
def cost_rollup(spark, d):
    return catalogue.cost_from_rollups(daily_runs(spark, d), "1-URGENT")


def _month(y, m):
    return dt.date(y, m, 1)


@query("long_window_mixed", f"""WITH {fx.RUNS_SQL} SELECT coalesce(lane,'{cv.BY_HAND}') AS lane, coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome,
  count(*) AS runs, round(sum(cost_usd::{DEC}),4)::DOUBLE AS cost_usd FROM runs
  WHERE time >= TIMESTAMP '1996-02-20' AND time < TIMESTAMP '2001-08-03' GROUP BY 1,2""")
def long_window_mixed(spark, d):
    """Months to 2000, days to June 2001, the records since: each day once."""
    since, until = dt.datetime(1996, 2, 20, 9), dt.datetime(2001, 8, 2, 12)
    daily = daily_runs(spark, d)
    months = [_month(y, m) for y in range(1995, 2001) for m in range(1, 13)]
    days = [x for x in rollups.window_days(since, until) if x < dt.date(2001, 7, 1)]
    rows = rollups.spliced("runs", rollups.monthly_runs(daily), daily, received(spark, d), since, until, months, days)
    return catalogue.runs_from_rollups(rows).select("lane", "outcome", "runs", "cost_usd")


@query("item_index", f"""WITH {fx.RUNS_SQL}, {fx.LOGS_SQL} SELECT item_key, date_trunc('hour',time) AS hour, signal, step_id, trace_id,
  min(time) AS first_seen, max(time) AS last_seen FROM (SELECT item_key,'traces' AS signal,step_id,trace_id,time FROM runs
  UNION ALL SELECT item_key,'logs',step_id,trace_id,time FROM logs) GROUP BY ALL""")
def item_index_query(spark, d):
    cols = ["item_key", "step_id", "trace_id", "time"]
    both = (fx.runs(spark, d).select(*cols, F.lit("traces").alias("signal"))
            .unionByName(fx.log_rows(spark, d).select(*cols, F.lit("logs").alias("signal"))))
    return item_index(both.withColumn("hour", F.date_trunc("hour", "time")))
