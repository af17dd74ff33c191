"""Reports, counters and plans on the fixture tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite.named import MONEY, SPANS_SQL, all_spans, steps
from suite.registry import query
from tracehold import conventions as cv
from tracehold.operators import governance, quality, reports
from tracehold.plans import catalogue
from tracehold.sources.batches import clean_line, line_status
from tracehold.sources.keys import parse_key
from tracehold.streaming.live import run_counts

RUNS_ANSWER = f"""{fx.RUNS_SQL}, answer AS (SELECT coalesce(lane,'{cv.BY_HAND}') AS lane, coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome,
  count(*) AS runs, round(median(duration_ms)/1000,1) AS median_s, {MONEY} AS cost_usd, max(time) AS last FROM runs GROUP BY 1,2)"""


def answer(spark, d):
    return catalogue.runs(fx.runs(spark, d), fx.SINCE, fx.UNTIL)


@query("lane_summary", f"""WITH {RUNS_ANSWER} SELECT lane, sum(runs)::BIGINT AS runs,
  coalesce(sum(runs) FILTER (WHERE outcome='converged'),0)::BIGINT AS converged,
  round(coalesce(sum(runs) FILTER (WHERE outcome='converged'),0)*100/sum(runs)) AS yield_pct,
  round(sum(cost_usd::DECIMAL(38,9)),2)::DOUBLE AS cost_usd, max(last) AS last, arg_min(median_s,(-runs,outcome)) AS median_s FROM answer GROUP BY lane""")
def lane_summary(spark, d):
    return reports.lane_summary(answer(spark, d))


@query("outcome_matrix", f"""WITH {RUNS_ANSWER} SELECT lane, coalesce(sum(runs) FILTER (WHERE outcome='converged'),0)::BIGINT AS converged,
  coalesce(sum(runs) FILTER (WHERE outcome='budget'),0)::BIGINT AS budget, coalesce(sum(runs) FILTER (WHERE outcome='{cv.NO_OUTCOME}'),0)::BIGINT AS "{cv.NO_OUTCOME}"
  FROM answer GROUP BY lane""")
def outcome_matrix(spark, d):
    return reports.outcome_matrix(answer(spark, d), ["converged", "budget", cv.NO_OUTCOME])


@query("cost_share", f"""WITH {fx.RUNS_SQL}, c AS (SELECT coalesce(model,'{cv.NO_MODEL}') AS model, {MONEY} AS cost_usd FROM runs GROUP BY 1)
  SELECT model, cost_usd, round(cost_usd*100/(SELECT sum(cost_usd::DECIMAL(38,9))::DOUBLE FROM c)*10000)/10000 AS share_pct FROM c""")
def cost_share(spark, d):
    return reports.cost_share(catalogue.cost(fx.runs(spark, d), fx.SINCE, fx.UNTIL))


@query("waterfall", f"""WITH {SPANS_SQL}, t AS (SELECT *, epoch_us(time) AS st, round(coalesce(duration_ms,0)*1000)::BIGINT AS ln FROM spans),
  e AS (SELECT trace_id, min(st) AS fr, max(st+ln) AS upto FROM t GROUP BY trace_id),
  x AS (SELECT t.*, (st-fr)*100.0::DOUBLE/(CASE WHEN upto>fr THEN upto-fr ELSE 1000 END) AS lft,
    ln*100.0::DOUBLE/(CASE WHEN upto>fr THEN upto-fr ELSE 1000 END) AS wid FROM t JOIN e USING (trace_id))
  SELECT trace_id, span_id, name, round(lft*1e6)/1e6 AS left_pct, round(least(greatest(0.3::DOUBLE,wid),100.0::DOUBLE-lft)*1e6)/1e6 AS width_pct FROM x""")
def waterfall(spark, d):
    w = reports.waterfall(all_spans(spark, d))
    return w.select("trace_id", "span_id", "name", *[(F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ("left_pct", "width_pct")])


@query("hourly_counts", f"""WITH {fx.RUNS_SQL} SELECT date_trunc('hour',time) AS hour, coalesce(lane,'{cv.BY_HAND}') AS lane,
  coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome, count(*) AS runs FROM runs GROUP BY 1,2,3""")
def hourly_counts(spark, d):
    return run_counts(fx.runs(spark, d))


@query("null_bucket_groups", f"""WITH {fx.RUNS_SQL} SELECT coalesce(lane,'{cv.BY_HAND}') AS lane, coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome,
  coalesce(model,'{cv.NO_MODEL}') AS model, count(*) AS n FROM runs GROUP BY 1,2,3""")
def null_bucket_groups(spark, d):
    return fx.runs(spark, d).groupBy(F.coalesce("lane", F.lit(cv.BY_HAND)).alias("lane"), F.coalesce("outcome", F.lit(cv.NO_OUTCOME)).alias("outcome"),
                                     F.coalesce("model", F.lit(cv.NO_MODEL)).alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query("median_by_service", f"WITH {fx.STEPS_SQL} SELECT name, service, round(median(cost_usd)*1e6)/1e6 AS median_cost FROM steps GROUP BY 1,2")
def median_by_service(spark, d):
    from tracehold.operators.median import grouped_median
    return grouped_median(steps(spark, d), ["name", "service"], "cost_usd").select("name", "service", (F.round(F.col("median") * 1e6) / 1e6).alias("median_cost"))


@query("span_counts", f"WITH {SPANS_SQL} SELECT service, name, count(*) AS spans FROM spans GROUP BY 1,2")
def span_counts(spark, d):
    return reports.span_counts(all_spans(spark, d))


# --- retention, budgets, hygiene ------------------------------------------------------------------
def _listing(spark, d):
    o, p = fx.spread(fx.table(spark, d, "orders")), fx.spread(fx.points(spark, d))
    ulid = F.lpad(F.col("o_orderkey").cast("string"), 26, "0")
    at = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    batches = o.select(F.concat(F.lit("traces/"), F.date_format(at, "yyyy/MM/dd/HH"), F.lit("/c"), F.col("o_custkey") % 9, F.lit("/"), ulid,
                                F.lit("_local.f-0-"), "o_orderkey", F.lit(".jsonl.gz")).alias("key"), F.col("o_totalprice").cast("bigint").alias("size"))
    parts = p.select(F.concat(F.lit("compacted/metrics/"), F.date_format("time", "yyyy/MM/dd/HH"), F.lit("/part-"), F.col("record_id").cast("int") + 1,
                              F.lit(".parquet")).alias("key"), F.lit(1000).cast("bigint").alias("size"))
    rolled = o.select(F.concat(F.lit("rollups/runs/daily/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".parquet")).alias("key"),
                      F.lit(7).cast("bigint").alias("size")).distinct()
    other = fx.table(spark, d, "documents").select(F.concat(F.lit("registries/"), "doc_id").alias("key"), F.col("n_chars").alias("size"))
    return batches.union(parts).union(rolled).union(other)


LISTING = """listing AS (SELECT 'traces/'||strftime(o_orderdate+to_hours((o_orderkey%24)::INTEGER),'%Y/%m/%d/%H')||'/c'||(o_custkey%9)||'/'||lpad(o_orderkey::VARCHAR,26,'0')||'_local.f-0-'||o_orderkey||'.jsonl.gz' AS key,
   trunc(o_totalprice)::BIGINT AS size, 'batch' AS kind, o_orderdate+to_hours((o_orderkey%24)::INTEGER) AS st, o_orderdate+to_hours((o_orderkey%24)::INTEGER)+INTERVAL 1 HOUR AS en, false AS rollup FROM orders
  UNION ALL SELECT 'compacted/metrics/'||strftime(ts,'%Y/%m/%d/%H')||'/part-'||(event_id+1)||'.parquet', 1000, 'compacted', date_trunc('hour',ts), date_trunc('hour',ts)+INTERVAL 1 HOUR, false FROM events
  UNION ALL SELECT DISTINCT 'rollups/runs/daily/'||strftime(o_orderdate,'%Y-%m-%d')||'.parquet', 7, 'daily', date_trunc('day',o_orderdate), date_trunc('day',o_orderdate)+INTERVAL 1 DAY, true FROM orders
  UNION ALL SELECT 'registries/'||doc_id, n_chars, 'ignored', NULL, NULL, false FROM documents)"""


@query("parse_keys", f"WITH {LISTING} SELECT key, kind, st AS start, en AS \"end\", rollup FROM listing")
def parse_keys(spark, d):
    return _listing(spark, d).withColumn("p", parse_key(F.col("key"))).select("key", "p.kind", "p.start", "p.end", "p.rollup")


@query("retention_plan", f"""WITH {LISTING}, k AS (SELECT * FROM listing WHERE kind<>'ignored'),
  aged AS (SELECT *, CASE WHEN rollup THEN en < TIMESTAMP '2001-08-02' - INTERVAL 396 DAY ELSE en < TIMESTAMP '2001-08-02' - INTERVAL 700 DAY END AS old FROM k),
  units AS (SELECT st, sum(size) AS s FROM aged WHERE NOT old AND NOT rollup GROUP BY st),
  kept AS (SELECT st, sum(s) OVER (ORDER BY st DESC) AS upto FROM units)
  SELECT key, size, 'age' AS reason FROM aged WHERE old UNION ALL
  SELECT key, size, 'size' FROM aged JOIN kept USING (st) WHERE NOT old AND NOT rollup AND upto > 300000000""")
def retention_plan(spark, d):
    return reports.retention_plan(_listing(spark, d), dt.datetime(2001, 8, 2), dt.timedelta(days=700), dt.timedelta(days=396), 300_000_000)


@query("eviction_plan", """WITH f AS (SELECT 'runs/'||source||'/'||doc_id||CASE WHEN lang='de' THEN '.open.jsonl' ELSE '.jsonl' END AS path, n_chars AS size, doc_id, lang FROM documents),
  o AS (SELECT coalesce(sum(size) FILTER (WHERE lang='de'),0) AS held FROM f),
  k AS (SELECT path, size, sum(size) OVER (ORDER BY doc_id DESC) AS upto FROM f WHERE lang<>'de')
  SELECT path, size FROM k, o WHERE upto + held > 1500000""")
def eviction_plan(spark, d):
    """Documents as spool files that were written one a second."""
    x = fx.table(spark, d, "documents")
    files = x.select(F.concat(F.lit("runs/"), "source", F.lit("/"), "doc_id", F.when(F.col("lang") == "de", ".open.jsonl").otherwise(".jsonl")).alias("path"),
                     F.col("n_chars").alias("size"), F.timestamp_seconds("doc_id").alias("modified"))
    return reports.eviction_plan(files, 1_500_000)


@query("byte_budget", """WITH b AS (SELECT source AS run, sum(strlen(text)) AS total, sum(strlen(text))//2 AS budget FROM documents WHERE source<>'src3' GROUP BY source),
  x AS (SELECT doc_id, source AS run, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents)
  SELECT doc_id, x.run, upto <= coalesce(budget, 67108864) AS kept, coalesce(total>budget, false) AS over_budget FROM x LEFT JOIN b USING (run)""")
def byte_budget(spark, d):
    lines = fx.lines(spark, d).select("doc_id", "run", F.col("chunk").alias("file"), F.col("doc_id").alias("offset"), F.octet_length("line").cast("bigint").alias("bytes"))
    budgets = lines.filter("run <> 'src3'").groupBy("run").agg(F.expr("sum(bytes) div 2").alias("budget"))
    return governance.within_budget(lines, budgets).select("doc_id", "run", "kept", "over_budget")


@query("line_hygiene", """SELECT source AS run, CASE WHEN strlen(text)>4096 THEN 'oversized' WHEN trim(text)='' THEN 'blank' ELSE 'malformed' END AS status,
  count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1,2""")
def line_hygiene(spark, d):
    line = clean_line(F.col("line"))
    return fx.lines(spark, d).groupBy("run", line_status(line, 4096).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(line)).alias("bytes"))


@query("reader_counters", """SELECT count(*) FILTER (WHERE strlen(text)<=2000) AS malformed, count(*) FILTER (WHERE strlen(text)>2000) AS oversized,
  0::BIGINT AS lines, 0::BIGINT AS blank, 0::BIGINT AS ignored FROM documents""")
def reader_counters(spark, d):
    from tracehold.sources.spool import counters
    return counters(fx.lines(spark, d).select(line_status(F.col("line"), 2000).alias("status")))


@query("evidence_cap", f"""WITH {fx.STEPS_SQL}, bad AS (SELECT service, record_id FROM steps WHERE outcome IS NULL),
  r AS (SELECT service, record_id, row_number() OVER (PARTITION BY service ORDER BY record_id)::INTEGER AS rank, count(*) OVER (PARTITION BY service) AS n FROM bad)
  SELECT service, record_id, rank, greatest(n-6,0) AS more FROM r WHERE rank<=6""")
def evidence_cap(spark, d):
    return reports.evidence(steps(spark, d).filter("outcome IS NULL").select("service", "record_id"), ["service"], ["record_id"])


# --- names, cardinality, contract -----------------------------------------------------------------
NAMES = """names AS (SELECT 'tool' AS service, 'v'||(user_id%3) AS version, event_type||'.'||json_extract_string(props,'$.k') AS name, json_extract_string(props,'$.k')::INT AS k, event_type FROM events),
 undeclared AS (SELECT service, version, name, count(*) AS count FROM names WHERE NOT (k<20 OR event_type='click') GROUP BY 1,2,3)"""


def _used(spark, d):
    return fx.log_rows(spark, d).select(F.lit("tool").alias("service"), F.concat(F.lit("v"), F.substring("actor", 2, 20).cast("bigint") % 3).alias("version"),
                                        F.lit("attribute").alias("kind"), F.concat("event", F.lit("."), F.col("labels")["k"]).alias("name"))


def _undeclared(spark, d):
    """Names outside a registry that declares click.* as a template and the small numbers by name."""
    used = _used(spark, d)
    counts = used.groupBy("service", "version", "kind", "name").agg(F.count(F.lit(1)).alias("count"))
    num = F.split_part("name", F.lit("."), F.lit(2)).cast("int")
    versions = used.select(F.col("service").alias("tool"), "version").distinct()
    named = used.filter(num < 20).select(F.col("service").alias("tool"), "version", "kind", "name", F.lit(False).alias("is_template")).distinct()
    registry = named.unionByName(versions.select("tool", "version", F.lit("attribute").alias("kind"), F.lit("click.").alias("name"), F.lit(True).alias("is_template")))
    return governance.undeclared(counts, registry).drop("kind")


@query("unknown_names", f"WITH {NAMES} SELECT * FROM undeclared")
def unknown_names(spark, d):
    return _undeclared(spark, d)


@query("unknown_names_capped", f"""WITH {NAMES}, r AS (SELECT *, row_number() OVER (ORDER BY service, version, name) AS rn FROM undeclared)
  SELECT service, version, name, count, false AS overflow FROM r WHERE rn<=100 UNION ALL
  SELECT NULL, NULL, NULL, sum(count)::BIGINT, true FROM r WHERE rn>100 HAVING count(*)>0""")
def unknown_names_capped(spark, d):
    return governance.capped(_undeclared(spark, d), ["service", "version", "name"], ["service", "version", "name"], 100)


@query("top_unknown", f"WITH {NAMES} SELECT * FROM undeclared ORDER BY count DESC, service, version, name LIMIT 20")
def top_unknown(spark, d):
    return reports.top_names(_undeclared(spark, d))


@query("cardinality_limits", """WITH v AS (SELECT event_type AS metric, 'k' AS attr, json_extract_string(props,'$.k') AS value FROM events
   UNION ALL SELECT event_type, 'user', user_id::VARCHAR FROM events),
  l(metric, attr, "limit") AS (VALUES ('click','k',50),('view','user',1000000),('error','k',100)),
  c AS (SELECT metric, attr, count(DISTINCT value) AS distinct_values FROM v GROUP BY 1,2)
  SELECT metric, attr, distinct_values, "limit"::INTEGER AS "limit", coalesce("limit">0 AND distinct_values>"limit", false) AS over FROM c LEFT JOIN l USING (metric, attr)""")
def cardinality_limits(spark, d):
    e = fx.table(spark, d, "events")
    pairs = F.array(F.struct(F.lit("k").alias("attr"), F.get_json_object("props", "$.k").alias("value")),
                    F.struct(F.lit("user").alias("attr"), F.col("user_id").cast("string").alias("value")))
    points = e.select(F.col("event_type").alias("metric"), F.explode(pairs).alias("p")).select("metric", "p.attr", "p.value")
    limits = spark.createDataFrame([("click", "k", 50), ("view", "user", 1000000), ("error", "k", 100)], "metric string, attr string, limit int")
    return reports.cardinality(points, limits)


@query("outcome_status_conflicts", f"""WITH {fx.STEPS_SQL} SELECT service, outcome, count(DISTINCT status) AS statuses FROM steps
  WHERE outcome IS NOT NULL GROUP BY 1,2 HAVING count(DISTINCT status)>1""")
def outcome_status_conflicts(spark, d):
    return quality.status_conflicts(steps(spark, d), ["service"])


@query("crash_detection", f"WITH {fx.RUNS_SQL}, {fx.STEPS_SQL} SELECT trace_id, time AS started FROM runs r WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.trace_id=r.trace_id)")
def crash_detection(spark, d):
    spans = fx.steps_copies(spark, d).select("trace_id")
    return fx.runs(spark, d).select("trace_id", F.col("time").alias("started")).join(spans.distinct(), "trace_id", "left_anti")


@query("started_pairs", """WITH t AS (SELECT lpad(lower(to_hex(conv_id)),32,'0') AS trace_id, turn, role FROM conversations),
  st AS (SELECT trace_id, turn+1 AS unit FROM t WHERE role='user'), sp AS (SELECT trace_id, turn AS unit FROM t WHERE role='assistant')
  SELECT trace_id, unit, 'no start' AS problem FROM sp WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.trace_id=sp.trace_id AND st.unit=sp.unit)
  UNION ALL SELECT trace_id, unit, 'no span' FROM st WHERE NOT EXISTS (SELECT 1 FROM sp WHERE st.trace_id=sp.trace_id AND st.unit=sp.unit)""")
def started_pairs(spark, d):
    t = fx.turns(spark, d)
    started = t.filter("role = 'user'").select("trace_id", (F.col("turn") + 1).alias("unit"))
    spans = t.filter("role = 'assistant'").select("trace_id", F.col("turn").alias("unit"))
    return quality.unmatched_starts(spans, started, ["trace_id", "unit"])


@query("canary_scan", "SELECT doc_id AS line_key, item_id::VARCHAR AS kind FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def canary_scan(spark, d):
    lines = fx.lines(spark, d).select(F.col("doc_id").alias("line_key"), "line")
    tokens = fx.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("kind"), F.col("text").alias("token"))
    return quality.scan_canaries(lines, tokens).select("line_key", "kind")


@query("multiset_diff", f"""WITH {fx.STEPS_SQL}, a AS (SELECT record_id, count(*) AS n FROM copies GROUP BY 1)
  SELECT record_id, 'left' AS side, n-1 AS times FROM a WHERE n>1""")
def multiset_diff(spark, d):
    return quality.multiset_diff(fx.steps_copies(spark, d).select("record_id"), steps(spark, d).select("record_id"))


@query("registry_diff", """WITH n AS (SELECT DISTINCT 'span' AS kind, event_type||'.'||json_extract_string(props,'$.k') AS name, user_id%2 AS half FROM events WHERE json_extract_string(props,'$.k')::BIGINT % 3 <> user_id%2),
  p AS (SELECT DISTINCT kind, name FROM n WHERE half=0), q AS (SELECT DISTINCT kind, name FROM n WHERE half=1)
  SELECT *, 'printed' AS side FROM (SELECT * FROM p EXCEPT SELECT * FROM q) UNION ALL SELECT *, 'declared' FROM (SELECT * FROM q EXCEPT SELECT * FROM p)""")
def registry_diff(spark, d):
    """The names users with an even id print against those the others declare."""
    e = fx.log_rows(spark, d).select(F.lit("span").alias("kind"), F.concat("event", F.lit("."), F.col("labels")["k"]).alias("name"),
                                     (F.substring("actor", 2, 20).cast("bigint") % 2).alias("half"))
    e = e.filter(F.substring_index("name", ".", -1).cast("bigint") % 3 != F.col("half"))
    return quality.registry_diff(e.filter("half = 0"), e.filter("half = 1"))


@query("rule_summary", f"""WITH {fx.STEPS_SQL}, c AS (SELECT CASE name WHEN 'step.A' THEN 1 WHEN 'step.N' THEN 2 ELSE 3 END AS rule,
   CASE WHEN outcome IS NULL AND service='s0' THEN 'fail' WHEN outcome IS NULL THEN 'skipped' ELSE 'pass' END AS status FROM steps)
  SELECT rule, CASE WHEN bool_or(status='fail') THEN 'fail' WHEN bool_or(status='pass') THEN 'pass' ELSE 'skipped' END AS status,
  count(*) FILTER (WHERE status='fail') AS failed FROM c GROUP BY rule""")
def rule_summary(spark, d):
    s = steps(spark, d)
    checks = s.select(F.when(F.col("name") == "step.A", 1).when(F.col("name") == "step.N", 2).otherwise(3).alias("rule"),
                      F.when(F.col("outcome").isNull() & (F.col("service") == "s0"), "fail").when(F.col("outcome").isNull(), "skipped").otherwise("pass").alias("status"))
    return quality.summarise(checks)


