"""The named queries on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite.registry import query
from tracehold import conventions as cv
from tracehold.operators.dedupe import combined, keep_one, new_records
from tracehold.operators.forest import trace_tree
from tracehold.plans import catalogue

MONEY = "round(sum(cost_usd::DECIMAL(38,9)),4)::DOUBLE"


def steps(spark, d):
    return keep_one(fx.steps_copies(spark, d), ["record_id"], fx.STEP_ORDER)


def all_spans(spark, d, trace_id=None):
    """Runs and steps together. One trace is picked before the copies are removed: copies share it."""
    cols = ["record_id", "time", "duration_ms", "trace_id", "span_id", "parent_span_id", "name", "service", "status",
            "outcome", "actor", "kind"]
    runs_, copies = fx.runs(spark, d).select(cols), fx.steps_copies(spark, d)
    if trace_id:
        runs_, copies = (x.filter(F.col("trace_id") == trace_id) for x in (runs_, copies))
    return runs_.unionByName(keep_one(copies, ["record_id"], fx.STEP_ORDER).select(cols))


SPANS_SQL = f"""{fx.RUNS_SQL}, {fx.STEPS_SQL}, spans AS (
  SELECT record_id,time,duration_ms,trace_id,span_id,parent_span_id,name,service,status,outcome,actor,'internal' AS kind FROM runs
  UNION ALL SELECT record_id,time,duration_ms,trace_id,span_id,parent_span_id,name,service,status,outcome,actor,'client' FROM steps)"""


@query("runs", f"""WITH {fx.RUNS_SQL} SELECT coalesce(lane,'{cv.BY_HAND}') AS lane, coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome,
  count(*) AS runs, round(median(duration_ms)/1000,1) AS median_s, {MONEY} AS cost_usd, max(time) AS last FROM runs GROUP BY 1,2""")
def runs(spark, d):
    return catalogue.runs(fx.runs(spark, d), fx.SINCE, fx.UNTIL)


@query("runs_lane_label", f"""WITH {fx.RUNS_SQL} SELECT coalesce(lane,'{cv.BY_HAND}') AS lane, coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome,
  count(*) AS runs, round(median(duration_ms)/1000,1) AS median_s, {MONEY} AS cost_usd, max(time) AS last FROM runs
  WHERE lane='2-HIGH' AND team='t3' GROUP BY 1,2""")
def runs_lane_label(spark, d):
    return catalogue.runs(fx.runs(spark, d), fx.SINCE, fx.UNTIL, lane="2-HIGH", labels=["team:t3"])


@query("recent", f"""WITH {fx.RUNS_SQL} SELECT time, coalesce(lane,'{cv.BY_HAND}') AS lane, item_key AS item, actor,
  coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome, model, round(duration_ms/1000,1) AS duration_s, round(cost_usd*10000)/10000 AS cost_usd,
  trace_id FROM runs ORDER BY time DESC, trace_id LIMIT 200""")
def recent(spark, d):
    return catalogue.recent(fx.runs(spark, d), fx.SINCE, fx.UNTIL)


@query("items", f"""WITH {fx.RUNS_SQL} SELECT item_key AS item, min(lane) AS lane, min(time) AS first_seen, max(time) AS last_seen,
  count(DISTINCT step_id) AS steps, count(DISTINCT trace_id) AS traces,
  any_value(ended) AS last_outcome FROM (SELECT *, last_value(outcome IGNORE NULLS) OVER (PARTITION BY item_key ORDER BY time, span_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ended FROM runs)
  GROUP BY item_key ORDER BY last_seen DESC, item LIMIT 200""")
def items(spark, d):
    return catalogue.items(fx.runs(spark, d), fx.SINCE, fx.UNTIL)


@query("item", f"""WITH {fx.RUNS_SQL}, {fx.LOGS_SQL} SELECT time,'span' AS record,name,service,actor,outcome,round(duration_ms,1) AS duration_ms,
  step_id,trace_id,span_id FROM runs WHERE item_key='cust#7' UNION ALL
  SELECT time,'event',event,service,actor,outcome,NULL,step_id,trace_id,span_id FROM logs WHERE item_key='cust#7' AND event IS NOT NULL""")
def item(spark, d):
    return catalogue.item(fx.runs(spark, d), fx.log_rows(spark, d), "cust#7", fx.SINCE, fx.UNTIL)


# All (span, ancestor) pairs by distance; a depth is their number, a path their times from the far end.
TREE_SQL = """, edge AS (SELECT c.trace_id, c.span_id, p.span_id AS up, p.time AS up_time
   FROM spans c JOIN spans p ON c.trace_id=p.trace_id AND c.parent_span_id=p.span_id),
  climb AS (SELECT trace_id, span_id, up, up_time, 1 AS far FROM edge
   UNION ALL SELECT k.trace_id, k.span_id, e.up, e.up_time, k.far+1 FROM climb k JOIN edge e ON k.trace_id=e.trace_id AND k.up=e.span_id),
  above AS (SELECT trace_id, span_id, count(*)::INTEGER AS n, list(up_time ORDER BY far DESC) AS times FROM climb GROUP BY ALL),
  tree AS (SELECT s.trace_id, s.span_id, coalesce(n, 0)::INTEGER AS depth, list_concat(coalesce(times, []), [s.time]) AS path
   FROM spans s LEFT JOIN above USING (trace_id, span_id))"""


@query("trace", f"""WITH RECURSIVE {SPANS_SQL}{TREE_SQL} SELECT s.time, tree.depth, s.name, s.service, s.actor, s.kind, s.status, s.outcome,
  round(s.duration_ms,1) AS duration_ms, s.span_id, s.parent_span_id FROM spans s JOIN tree USING (trace_id, span_id)
  WHERE s.trace_id=lpad('2f',32,'0')""")
def trace(spark, d):
    tid = "2f".rjust(32, "0")
    return catalogue.trace(all_spans(spark, d, tid), tid, fx.SINCE, fx.UNTIL)


@query("trace_forest", f"""WITH RECURSIVE {SPANS_SQL}{TREE_SQL} SELECT s.trace_id, s.span_id, tree.depth, len(tree.path)::INTEGER AS steps,
  s.name, s.time, tree.path[1] AS root_time FROM spans s JOIN tree USING (trace_id, span_id)""")
def trace_forest(spark, d):
    t = trace_tree(all_spans(spark, d))
    return t.select("trace_id", "span_id", "depth", F.size("path").alias("steps"), "name", "time", F.get("path", F.lit(0)).alias("root_time"))


@query("cost", f"""WITH {fx.RUNS_SQL} SELECT coalesce(model,'{cv.NO_MODEL}') AS model, count(*) AS runs, {MONEY} AS cost_usd,
  sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM runs GROUP BY 1""")
def cost(spark, d):
    return catalogue.cost(fx.runs(spark, d), fx.SINCE, fx.UNTIL)


@query("dedupe_records", f"""WITH {fx.STEPS_SQL} SELECT record_id, file, time, name, status, duration_ms, l_partkey FROM steps""")
def dedupe_records(spark, d):
    return steps(spark, d).select("record_id", "file", "time", "name", "status", "duration_ms", "l_partkey")


@query("combined_sources", f"""WITH {fx.RUNS_SQL}, both_sources AS (
  SELECT record_id, time, outcome, file FROM runs UNION ALL
  SELECT record_id, time, NULL, 'compacted/part-1' FROM runs WHERE time < TIMESTAMP '1998-01-01')
  SELECT record_id, time, outcome, file FROM both_sources
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY file)=1""")
def combined_sources(spark, d):
    r = fx.runs(spark, d).select("record_id", "time", "outcome", "file")
    part = r.filter("time < timestamp'1998-01-01'").select("record_id", "time").withColumn("file", F.lit("compacted/part-1"))
    return combined(r, part).select("record_id", "time", "outcome", "file")


@query("antijoin_new_records", f"""WITH {fx.RUNS_SQL}, {fx.STEPS_SQL} SELECT record_id, time FROM runs r WHERE NOT EXISTS (
  SELECT 1 FROM steps s WHERE s.trace_id||'/'||s.parent_span_id=r.record_id)""")
def antijoin_new_records(spark, d):
    held = fx.steps_copies(spark, d).select(F.concat("trace_id", F.lit("/"), "parent_span_id").alias("record_id"))
    return new_records(fx.runs(spark, d).select("record_id", "time"), held)
