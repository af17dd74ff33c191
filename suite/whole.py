"""Answers that leave nothing out: extreme values, all names, and the engine's own path through a store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite.decoded import run_lines
from suite.registry import query
from suite.reported import NAMES, _undeclared
from suite.rolled import DEC
from tracehold import conventions as cv
from tracehold.operators import governance
from tracehold.plans import catalogue, rollups
from tracehold.plans.engine import Engine
from tracehold.session import scratch, utc
from tracehold.sources.batches import nesting, parse_lines
from tracehold.streaming import hot, live
from tracehold.streaming.ship import write_batch

TINY, HUGE = 2.0 ** -60, 2.0 ** 90


@query("metric_rollup_extremes", f"""WITH {fx.POINTS_SQL}, x AS (SELECT received_day AS day, name, event_id%3 AS part, event_id%1000 AS n, value FROM points WHERE type<>'gauge' AND temporality='delta')
  SELECT day, name, part, CASE part WHEN 0 THEN sum(n*{TINY!r}::DOUBLE) WHEN 1 THEN sum(n*{HUGE!r}::DOUBLE) ELSE sum(value::{DEC})::DOUBLE END AS total,
  CASE part WHEN 0 THEN max(n*{TINY!r}::DOUBLE) WHEN 1 THEN max(n*{HUGE!r}::DOUBLE) ELSE max(value) END AS max, count(*) AS points FROM x GROUP BY day, name, part""")
def metric_rollup_extremes(spark, d):
    """A third of the values under 1e-15, a third over 1e27: multiples of powers of two, so that sums are exact."""
    part, n = F.col("record_id").cast("bigint") % 3, F.col("record_id").cast("bigint") % 1000
    p = fx.points(spark, d).filter("temporality = 'delta'").withColumn("service", part.cast("string"))
    p = p.withColumn("value", F.when(part == 0, n * F.lit(TINY)).when(part == 1, n * F.lit(HUGE)).otherwise(F.col("value"))).withColumn("attributes", F.slice("attributes", 1, 0))
    return (rollups.metric_rollup(p.withColumnRenamed("received_day", "day"))
            .select("day", "name", F.col("service").cast("bigint").alias("part"), "total", "max", "points"))


@query("cost_overflow", f"""WITH {fx.RUNS_SQL}, t AS (SELECT coalesce(model,'{cv.NO_MODEL}') AS model, CASE WHEN model='m1' THEN 9223372036854775807 ELSE input_tokens END AS i FROM runs)
  SELECT model, count(*) AS runs, TRY_CAST(sum(i::HUGEINT) AS BIGINT) AS input_tokens FROM t GROUP BY model""")
def cost_overflow(spark, d):
    """One model's token counts are the largest there is: its total has no value, the others keep theirs."""
    big = F.transform("attributes", lambda a: a.withField("v", F.when((a["k"] == cv.INPUT_TOKENS) & (F.col("model") == "m1"), "9223372036854775807").otherwise(a["v"])))
    return catalogue.cost(fx.runs(spark, d).withColumn("attributes", big), fx.SINCE, fx.UNTIL).select("model", "runs", "input_tokens")


@query("unknown_names_all", f"WITH {NAMES} SELECT service, version, name, count, false AS overflow FROM undeclared")
def unknown_names_all(spark, d):
    return governance.capped(_undeclared(spark, d), ["service", "version", "name"], ["service", "version", "name"])


# --- the engine: a window that leaves runs out on both sides, with one at its very end -----------------
SINCE, UNTIL = dt.datetime(1995, 3, 1), dt.datetime(1995, 4, 1)
WINDOW = f"time >= TIMESTAMP '{SINCE}' AND time < TIMESTAMP '{UNTIL}'"
WEEK_SINCE, WEEK_UNTIL = dt.datetime(1995, 3, 5), dt.datetime(1995, 3, 12)
WEEK = f"time >= TIMESTAMP '{WEEK_SINCE}' AND time < TIMESTAMP '{WEEK_UNTIL}'"
EDGES = f"""{fx.RUNS_SQL.replace("FROM orders)", f'''FROM (SELECT * REPLACE (CASE o_orderkey%5 WHEN 0 THEN TIMESTAMP '{UNTIL}' WHEN 1 THEN TIMESTAMP '{SINCE}' ELSE o_orderdate END AS o_orderdate) FROM orders))''')}"""


def _engine(spark, d):
    """Orders with a fifth of them at either end of the window, shipped twice and compacted between."""
    root, received = scratch(spark, "engine"), dt.datetime(1995, 3, 10, 8)
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    moved = F.when(key % 5 == 0, F.lit(utc(UNTIL))).when(key % 5 == 1, F.lit(utc(SINCE))).otherwise(date)
    orders = fx.spread(fx.table(spark, d, "orders")).filter(key.isNotNull() & date.isNotNull()).withColumn("o_orderdate", moved)  # without a time there is nothing to move
    lines = run_lines(spark, d, orders).withColumns({"class": F.lit("service"), "name": F.lit("svc"), "status": F.lit("ok"), "signal": F.lit("traces")})
    none = spark.createDataFrame([], "run string, valid boolean, lane string, harness string, focus string, item string, step string, budget bigint")
    e = Engine(spark, root, now=received + dt.timedelta(hours=5))
    write_batch(lines, none, root, "c1", "first", received=received)
    e.store.compact(e.now, lookback=dt.timedelta(hours=8))
    write_batch(lines, none, root, "c2", "again", received=received + dt.timedelta(minutes=20))
    return e


@query("engine_items", f"""WITH {EDGES} SELECT item_key AS item, count(DISTINCT trace_id) AS traces, count(DISTINCT step_id) AS steps, min(time) AS first_seen, max(time) AS last_seen
  FROM runs WHERE {WINDOW} GROUP BY item_key ORDER BY last_seen DESC, item LIMIT 200""")
def engine_items(spark, d):
    return _engine(spark, d).query("items", since=SINCE, until=UNTIL).select("item", "traces", "steps", "first_seen", "last_seen")


@query("engine_item", f"""WITH {EDGES} SELECT time, 'span' AS record, name, service, outcome, step_id, trace_id, span_id FROM runs WHERE {WINDOW} AND item_key='cust#7'""")
def engine_item(spark, d):
    return _engine(spark, d).query("item", "cust#7", since=SINCE, until=UNTIL).select("time", "record", "name", "service", "outcome", "step_id", "trace_id", "span_id")


@query("engine_recent", f"""WITH {EDGES} SELECT time, coalesce(lane,'{cv.BY_HAND}') AS lane, item_key AS item, trace_id FROM runs WHERE {WINDOW} ORDER BY time DESC, trace_id LIMIT 200""")
def engine_recent(spark, d):
    return _engine(spark, d).query("recent", since=SINCE, until=UNTIL).select("time", "lane", "item", "trace_id")


@query("hot_rebuild", f"""WITH {EDGES} SELECT time, coalesce(lane,'{cv.BY_HAND}') AS lane, item_key AS item, trace_id FROM runs WHERE {WINDOW}""")
def hot_rebuild(spark, d):
    """The hot tables of a store whose first batches were compacted and pruned, with copies of all records in
    batches beside the part: filled from both, streamed on, and asked for every run of the window."""
    e, path, window = _engine(spark, d), scratch(spark, "hot"), dt.timedelta(days=10)
    if not e.store.prune("traces", [dt.datetime(1995, 3, 10, 8)], e.now + dt.timedelta(hours=2), dt.timedelta(0)):
        raise RuntimeError("nothing was pruned")
    hot.hot_stream(spark, e.store.root, path, "traces", window, scratch(spark, "hot-ck"), now=e.now, every=None, store=e.store).awaitTermination()
    h = hot.Hot(e, path, window)
    h.query("recent", since=SINCE, until=UNTIL)
    if h.from_store:
        raise RuntimeError("answered from the store")
    return catalogue.recent(h._table("traces"), SINCE, UNTIL, newest=None).select("time", "lane", "item", "trace_id")


# --- values nested five levels deep -------------------------------------------------------------------
LEVELS = 5
_INNER = "$" + ".kvlistValue.values[0].value" * LEVELS


def _deep_lines(spark, d):
    """Each document's language in a map inside maps, each beside a private entry; lists on the way down."""
    text = lambda c: F.to_json(F.struct(c.alias("stringValue")))
    value = text(F.col("lang"))
    for _ in range(LEVELS):
        private = F.concat(F.lit('{"key":"cwd","value":'), text(F.col("source")), F.lit("}"))
        value = F.concat(F.lit('{"kvlistValue":{"values":[{"key":"k","value":'), value, F.lit("},"), private, F.lit("]}}"))
    head = '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"tool"}}]},"scopeLogs":[{"scope":{"name":"t"},"logRecords":[{"eventName":"doc","attributes":[{"key":"id","value":{"stringValue":"'
    line = F.concat(F.lit(head), F.col("doc_id").cast("string"), F.lit('"}},{"key":"deep","value":'), value, F.lit("}]}]}]}]}"))
    return fx.table(spark, d, "documents").select("doc_id", line.alias("line"))


@query("scrub_deep", f"SELECT doc_id, lang AS inner_text, {LEVELS}::BIGINT AS stripped FROM documents")
def scrub_deep(spark, d):
    lines = _deep_lines(spark, d)
    raw = parse_lines(lines, "logs", whole=True, depth=nesting(lines))
    out = governance.scrub(raw)
    before, after = (df.select("doc_id", governance.attribute_entries(df).cast("bigint").alias(n), F.to_json(F.col("resourceLogs")[0]["scopeLogs"][0]["logRecords"][0]["attributes"][1]["value"]).alias(f"{n}_v"))
                     for df, n in ((raw, "before"), (out, "after")))
    return before.join(after, "doc_id").select("doc_id", F.get_json_object("after_v", f"{_INNER}.stringValue").alias("inner_text"), (F.col("before") - F.col("after")).alias("stripped"))


@query("ship_roundtrip_deep", "SELECT doc_id, lang AS inner_text, source AS beside FROM documents")
def ship_roundtrip_deep(spark, d):
    """Shipped and read back as lines: stamped, and every nested value as it was."""
    root = scratch(spark, "deep")
    lines = _deep_lines(spark, d).drop("doc_id").withColumns({"class": F.lit("service"), "name": F.lit("svc"), "status": F.lit("ok"), "signal": F.lit("logs")})
    none = spark.createDataFrame([], "run string, valid boolean, lane string, harness string, focus string, item string, step string, budget bigint")
    write_batch(lines, none, root, "c1", "deep", received=dt.datetime(1995, 3, 10, 8))
    base = "$.resourceLogs[0].scopeLogs[0].logRecords[0].attributes"
    got = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl.gz").text(root)
    inner = base + "[1].value" + _INNER[1:]
    return got.select(F.get_json_object("value", f"{base}[0].value.stringValue").cast("bigint").alias("doc_id"), F.get_json_object("value", f"{inner}.stringValue").alias("inner_text"),
                      F.get_json_object("value", inner.removesuffix("[0].value") + "[1].value.stringValue").alias("beside"))


@query("store_retention", "SELECT lpad(lower(to_hex(o_orderkey)),32,'0') AS trace_id FROM orders WHERE o_orderkey%3<>0")
def store_retention(spark, d):
    """Orders received on three days, a third each: the store's own folders past five days go, batches and parts."""
    root, day = scratch(spark, "retention"), dt.datetime(1995, 3, 10, 8)
    lines = run_lines(spark, d)
    key = F.conv(F.get_json_object("line", "$.resourceSpans[0].scopeSpans[0].spans[0].spanId"), 16, 10).cast("bigint")
    lines = lines.withColumns({"class": F.lit("service"), "name": F.lit("svc"), "status": F.lit("ok"), "signal": F.lit("traces"), "third": key % 3})
    none = spark.createDataFrame([], "run string, valid boolean, lane string, harness string, focus string, item string, step string, budget bigint")
    for third in range(3):
        write_batch(lines.filter(F.col("third") == third).drop("third"), none, root, "c1", f"day{third}", received=day + dt.timedelta(days=4 * third))
    now = day + dt.timedelta(days=8, hours=5)
    store = Engine(spark, root, now=now).store
    store.compact(now, lookback=dt.timedelta(days=9))
    store.retain(now, records=dt.timedelta(days=5))
    return store.table("traces", [day + dt.timedelta(days=4 * third) for third in range(3)]).select("trace_id")


# --- units that never ended, from a stream out of order ------------------------------------------------
GRACE, LAST = 60, "2100-01-01"


@query("stream_unfinished", f"""SELECT lpad(lower(to_hex(o_orderkey)),32,'0') AS trace_id, o_orderdate::TIMESTAMP AS started FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_linenumber=2 AND l_shipdate BETWEEN o_orderdate-INTERVAL {GRACE} DAY AND o_orderdate+INTERVAL {GRACE} DAY)""")
def stream_unfinished(spark, d):
    """Orders as starts, their second lines as spans; marks come twice, in two deliveries, and up to ``GRACE`` days late."""
    src, out, ck = scratch(spark, "marks"), scratch(spark, "unfinished"), scratch(spark, "unfinished-ck")
    trace = lambda c: F.lpad(F.lower(F.hex(c)), 32, "0").alias("trace_id")
    mark = lambda key, what, time: [trace(key), F.lit("order").alias("unit"), F.lit(what).alias("what"), F.col(time).cast("timestamp").alias("time")]
    marks = (fx.table(spark, d, "orders").select(*mark("o_orderkey", "start", "o_orderdate"), F.col("o_orderkey").alias("n"))
             .unionByName(fx.table(spark, d, "lineitem").filter("l_linenumber = 2").select(*mark("l_orderkey", "span", "l_shipdate"), F.col("l_orderkey").alias("n"))))
    arrival = F.col("time") + F.make_dt_interval((F.col("n") % GRACE).cast("int"))
    first = arrival < F.lit("1995-01-01").cast("timestamp")
    end = spark.sql(f"SELECT 'z' AS trace_id, 'order' AS unit, 'start' AS what, TIMESTAMP '{LAST}' AS time")
    deliveries = (marks.filter(first).drop("n"), marks.filter(~first).drop("n"), end)
    for rows in deliveries:
        rows.unionByName(rows).write.mode("append").parquet(src)
        (live.unfinished_stream(spark.readStream.schema(end.schema).parquet(src), f"{GRACE} days").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out).select("trace_id", "started")


@query("engine_runs", f"""WITH {EDGES} SELECT coalesce(lane,'{cv.BY_HAND}') AS lane, coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome, count(*) AS runs,
  round(median(duration_ms)/1000,1) AS median_s, round(sum(cost_usd::DECIMAL(38,9)),4)::DOUBLE AS cost_usd, max(time) AS last FROM runs WHERE {WEEK} GROUP BY 1,2""")
def engine_runs(spark, d):
    return _engine(spark, d).query("runs", since=WEEK_SINCE, until=WEEK_UNTIL)


@query("engine_cost", f"""WITH {EDGES} SELECT coalesce(model,'{cv.NO_MODEL}') AS model, count(*) AS runs, sum(input_tokens)::BIGINT AS input_tokens,
  round(sum(cost_usd::DECIMAL(38,9)),4)::DOUBLE AS cost_usd FROM runs WHERE {WEEK} GROUP BY 1""")
def engine_cost(spark, d):
    return _engine(spark, d).query("cost", since=WEEK_SINCE, until=WEEK_UNTIL).select("model", "runs", "input_tokens", "cost_usd")
