"""Scalar functions and the whole path from OTLP JSON text, on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite.registry import query
from tracehold import conventions as cv
from tracehold.functions import otel, text
from tracehold.operators import flatten, governance
from tracehold.session import scratch
from tracehold.sources.batches import line_signal, parse_lines


def _kv(key: str, value: str, field: str = "stringValue") -> str:
    kinds = {"stringValue": "string", "intValue": "string", "doubleValue": "double"}
    fields = ", ".join(f"'{f}', cast({value if f == field else 'null'} as {t})" for f, t in kinds.items())
    return f"named_struct('key', '{key}', 'value', named_struct({fields}))"


def _line(column: str, scopes: str, records: str, resource: list[str], record: str) -> str:
    return (f"to_json(named_struct('{column}', array(named_struct('resource', named_struct('attributes', array({', '.join(resource)})), "
            f"'{scopes}', array(named_struct('scope', named_struct('name', 'fixture'), '{records}', array({record})))))))")


NS = "cast(unix_micros({}) * 1000 as string)"
HEX = "lpad(lower(hex({})), {}, '0')"


def run_lines(spark, d, orders=None):
    """Each order as one export request with its run span; text that no reader has parsed yet."""
    o = fx.spread(fx.table(spark, d, "orders")) if orders is None else orders
    span = ("named_struct('traceId', upper({t}), 'spanId', {s}, 'parentSpanId', '', 'name', '{name}', 'kind', 1, 'startTimeUnixNano', {st}, "
            "'endTimeUnixNano', {en}, 'attributes', array({at}), 'status', named_struct('code', if(o_orderstatus = 'O', 2, 1)))").format(
        t=HEX.format("o_orderkey", 32), s=HEX.format("o_orderkey", 16), name=cv.RUN_SPAN, st=NS.format("o_orderdate"),
        en="cast((unix_micros(o_orderdate) + (o_orderkey % 997) * 100000) * 1000 as string)",
        at=", ".join([_kv(cv.RUN_OUTCOME, "case o_orderstatus when 'F' then 'converged' when 'O' then 'budget' end"),
                      _kv(cv.RESPONSE_MODEL, "if(o_orderkey % 7 <> 6, concat('m', o_orderkey % 7), null)"),
                      _kv(cv.RUN_COST, "o_totalprice / 1000", "doubleValue"), _kv(cv.INPUT_TOKENS, "1000 + o_orderkey % 500", "intValue"),
                      _kv(cv.OUTPUT_TOKENS, "cast(200 + o_orderkey % 100 as string)", "intValue"), _kv(cv.USER_NAME, "concat('c', o_custkey)")]))
    res = [_kv(cv.SERVICE_NAME, "'runner'"), _kv(cv.LANE, "if(o_orderpriority <> '5-LOW', o_orderpriority, null)"),
           _kv(cv.ITEM_KEY, "concat('cust#', o_custkey)"), _kv(cv.STEP_ID, "concat('step', o_orderkey % 5)"),
           _kv(cv.LABEL_PREFIX + "team", "concat('t', o_custkey % 5)"), _kv(cv.LABEL_PREFIX + "team", "'second'")]
    return o.selectExpr(_line("resourceSpans", "scopeSpans", "spans", res, span) + " AS line", "concat('b', o_orderkey % 16) AS file")


def event_lines(spark, d):
    e = fx.spread(fx.table(spark, d, "events"))
    rec = ("named_struct('timeUnixNano', {t}, 'severityNumber', 9, 'severityText', 'INFO', 'eventName', if(event_type = 'view', '', event_type), 'body', "
           "named_struct('stringValue', props), 'attributes', array({a}), 'traceId', {tr}, 'spanId', {sp})").format(
        t=NS.format("ts"), a=", ".join([_kv("event.name", "if(event_type = 'view', 'seen', null)"), _kv("k", "get_json_object(props, '$.k')", "intValue")]),
        tr=HEX.format("user_id", 32), sp=HEX.format("event_id", 16))
    res = [_kv(cv.SERVICE_NAME, "'tool'"), _kv(cv.RECEIVED_AT, "cast(ts as string)")]
    return e.selectExpr(_line("resourceLogs", "scopeLogs", "logRecords", res, rec) + " AS line", "concat('f', event_id % 8) AS file")


def metric_lines(spark, d):
    e = fx.spread(fx.table(spark, d, "events"))
    common = f"'timeUnixNano', {NS.format('ts')}, 'startTimeUnixNano', {NS.format('date_trunc(\"day\", ts)')}, 'attributes', array({_kv('k', 'cast(event_id as string)')})"
    num = f"array(named_struct({common}, 'asDouble', value))"
    his = f"array(named_struct({common}, 'count', 3, 'sum', value))"
    rec = (f"named_struct('name', event_type, 'unit', '1', 'gauge', if(event_type = 'view', named_struct('dataPoints', {num}), null), "
           f"'sum', if(event_type in ('click', 'error', 'purchase'), named_struct('dataPoints', {num}, 'aggregationTemporality', if(event_type = 'purchase', 2, 1), 'isMonotonic', true), null), "
           f"'histogram', if(event_type = 'signup', named_struct('dataPoints', {his}, 'aggregationTemporality', 'AGGREGATION_TEMPORALITY_CUMULATIVE'), null))")
    return e.selectExpr(_line("resourceMetrics", "scopeMetrics", "metrics", [_kv(cv.SERVICE_NAME, "'tool'")], rec) + " AS line", "concat('f', event_id % 8) AS file")


@query("otlp_spans", f"""WITH {fx.RUNS_SQL} SELECT record_id, time, time + to_milliseconds(duration_ms) AS end_time, duration_ms, trace_id, span_id, name,
  'internal' AS kind, status, service, item_key, step_id, lane, outcome, actor, model, team, cost_usd, input_tokens, file FROM runs""")
def otlp_spans(spark, d):
    s = flatten.spans(parse_lines(run_lines(spark, d), "traces"))
    return s.select("record_id", "time", "end_time", "duration_ms", "trace_id", "span_id", "name", "kind", "status", "service", "item_key", "step_id", "lane",
                    "outcome", "actor", "model", F.col("labels")["team"].alias("team"), "cost_usd",
                    otel.attr(F.col("attributes"), cv.INPUT_TOKENS).cast("bigint").alias("input_tokens"), "file")


@query("otlp_logs", """SELECT ts AS time, CASE WHEN event_type='view' THEN 'seen' ELSE event_type END AS event, 'INFO' AS severity, 9 AS severity_number,
  props AS body, lpad(lower(to_hex(user_id)),32,'0') AS trace_id, lpad(lower(to_hex(event_id)),16,'0') AS span_id, 'tool' AS service,
  json_extract_string(props,'$.k') AS k, date_trunc('second',ts) AS received_at FROM events""")
def otlp_logs(spark, d):
    """Every record comes twice, the second time with another receipt stamp, and is kept once."""
    raw = parse_lines(event_lines(spark, d), "logs")
    again = parse_lines(event_lines(spark, d).withColumn("line", F.replace("line", F.lit('"2024-'), F.lit('"2025-'))).withColumn("file", F.concat(F.lit("z"), "file")), "logs")
    g = flatten.logs(raw.unionByName(again))
    return g.select("time", "event", "severity", "severity_number", "body", "trace_id", "span_id", "service",
                    otel.attr(F.col("attributes"), "k").alias("k"), F.date_trunc("second", "received_at").alias("received_at"))


@query("otlp_metric_points", f"""WITH {fx.POINTS_SQL} SELECT time, start_time, name, unit, type, temporality, CASE WHEN type='sum' THEN true END AS monotonic,
  value, CASE WHEN type='histogram' THEN 3.0::DOUBLE END AS count, service, event_id::VARCHAR AS k FROM points""")
def otlp_metric_points(spark, d):
    p = flatten.metric_points(parse_lines(metric_lines(spark, d), "metrics"))
    return p.select("time", "start_time", "name", "unit", "type", "temporality", "monotonic", "value", "count", "service", otel.attr(F.col("attributes"), "k").alias("k"))


@query("tail_records", f"""WITH {fx.RUNS_SQL}, {fx.POINTS_SQL} SELECT 'span' AS kind, service, name, lane, item_key AS item, outcome, count(*) AS n, NULL::DOUBLE AS top FROM runs GROUP BY ALL
  UNION ALL SELECT 'event', 'tool', CASE WHEN event_type='view' THEN 'seen' ELSE event_type END, NULL, NULL, NULL, count(*), NULL FROM events GROUP BY ALL
  UNION ALL SELECT 'metric', service, name, NULL, NULL, NULL, count(*), max(value) FROM points GROUP BY ALL""")
def tail_records(spark, d):
    r = flatten.records(parse_lines(run_lines(spark, d), "traces"), parse_lines(event_lines(spark, d), "logs"), parse_lines(metric_lines(spark, d), "metrics"))
    return flatten.keep_records(r).groupBy("kind", "service", "name", "lane", "item", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query("signal_probe", """SELECT 'traces' AS signal, count(*) AS n FROM orders UNION ALL SELECT 'logs', count(*) FROM events
  UNION ALL SELECT 'metrics', count(*) FROM events UNION ALL SELECT 'none', count(*) FROM documents""")
def signal_probe(spark, d):
    lines = (run_lines(spark, d).select("line").union(event_lines(spark, d).select("line")).union(metric_lines(spark, d).select("line"))
             .union(fx.lines(spark, d).select("line")))
    return lines.groupBy(F.coalesce(line_signal(F.col("line")), F.lit("none")).alias("signal")).agg(F.count(F.lit(1)).alias("n"))


@query("label_match", f"""WITH {fx.RUNS_SQL} SELECT record_id, team='t1' AND tier='p0' AS both_match, team='t1' AS one_match, true AS no_wish, false AS absent FROM runs""")
def label_match(spark, d):
    m = F.col("labels")
    return fx.runs(spark, d).select("record_id", otel.labels_match(m, ["team:t1", "tier:p0"]).alias("both_match"), otel.labels_match(m, F.lit("team:t1")).alias("one_match"),
                                    otel.labels_match(m, F.lit("")).alias("no_wish"), otel.labels_match(m, ["other:x"]).alias("absent"))


HANDLES = [f"c{i}" for i in range(1, 51)]


@query("erasure_mask", f"""WITH {fx.RUNS_SQL} SELECT record_id, CASE WHEN actor IN ({', '.join(repr(h) for h in HANDLES)}) THEN '{cv.ERASED}' ELSE actor END AS actor,
  CASE WHEN actor IN ({', '.join(repr(h) for h in HANDLES)}) THEN '{cv.ERASED}' ELSE actor END AS user_name, actor IN ({', '.join(repr(h) for h in HANDLES)}) AS held FROM runs""")
def erasure_mask(spark, d):
    r = fx.runs(spark, d)
    masked = otel.mask_attrs(F.col("attributes"), HANDLES)
    return r.select("record_id", otel.mask_actor(F.col("actor"), HANDLES).alias("actor"), otel.attr(masked, cv.USER_NAME).alias("user_name"),
                    otel.holds_erased(F.col("resource"), F.col("attributes"), HANDLES).alias("held"))


@query("otel_time", """SELECT event_id, ts AS quoted, ts AS plain, NULL::TIMESTAMP AS zero, NULL::TIMESTAMP AS words, value AS num, CASE WHEN value>0 THEN value END AS ms FROM events""")
def otel_time(spark, d):
    e, us = fx.table(spark, d, "events"), F.unix_micros("ts") * 1000
    span = otel.span_duration_ms(us.cast("string"), (us + F.round(F.col("value") * 1e6).cast("bigint")).cast("string"))
    return e.select("event_id", otel.otel_time(F.concat(F.lit('"'), us, F.lit('"'))).alias("quoted"), otel.otel_time(us.cast("string")).alias("plain"),
                    otel.otel_time(F.lit("0")).alias("zero"), otel.otel_time(F.col("event_type")).alias("words"),
                    otel.otel_num(F.concat(F.lit('"'), "value", F.lit('"'))).alias("num"), F.when(F.col("value") > 0, F.round(span, 6)).alias("ms"))


@query("otel_enums", """WITH x AS (SELECT l_linenumber AS n, l_returnflag AS f, count(*) AS c FROM lineitem GROUP BY 1,2)
  SELECT n, f, c, CASE n WHEN 1 THEN 'internal' WHEN 2 THEN 'server' WHEN 3 THEN 'client' WHEN 4 THEN 'producer' WHEN 5 THEN 'consumer' ELSE 'unspecified' END AS kind,
  CASE f WHEN 'A' THEN 'server' ELSE 'unspecified' END AS kind_name, CASE n WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unset' END AS status,
  CASE n WHEN 1 THEN 'delta' WHEN 2 THEN 'cumulative' END AS temporality FROM x""")
def otel_enums(spark, d):
    l = fx.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f")).agg(F.count(F.lit(1)).alias("c"))
    n = F.concat(F.lit('"'), F.col("n"), F.lit('"'))
    return l.select("n", "f", "c", otel.otel_kind(n).alias("kind"), otel.otel_kind(F.when(F.col("f") == "A", "SPAN_KIND_SERVER").otherwise("x")).alias("kind_name"),
                    otel.otel_status(n).alias("status"), otel.otel_temporality(n).alias("temporality"))


@query("outcome_class", """SELECT event_type AS outcome, CASE event_type WHEN 'error' THEN 'bad' ELSE 'none' END AS class, count(*) AS n FROM events GROUP BY 1
  UNION ALL SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'O' THEN 'warn' ELSE 'none' END, count(*) FROM orders GROUP BY 1""")
def outcome_class(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("outcome"), F.col("event_type").alias("o"))
    r = fx.table(spark, d, "orders").select(F.col("o_orderstatus").alias("outcome"), F.when(F.col("o_orderstatus") == "F", "converged").when(F.col("o_orderstatus") == "O", "budget"))
    return e.union(r).groupBy("outcome", text.outcome_class(F.col("o")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


WORDS = "words AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents)"


def words(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("w"))


@query("id_like", f"""WITH {WORDS} SELECT CASE WHEN regexp_full_match(w,'[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') THEN 'a UUID'
   WHEN regexp_full_match(w,'[0-9A-HJKMNP-TV-Z]{{26}}') THEN 'a ULID' WHEN regexp_full_match(w,'(0x)?[0-9a-fA-F]{{16,}}') THEN 'a hash or trace id'
   WHEN regexp_full_match(w,'item/\\S+|[A-Z][A-Z0-9]+-\\d+|\\S+/\\S+#\\d+') THEN 'an item key' ELSE '-' END AS what, count(*) AS n FROM words GROUP BY 1
  UNION ALL SELECT 'trace', count(*) FROM orders""")
def id_like(spark, d):
    w = words(spark, d).groupBy(F.coalesce(text.id_like(F.col("w")), F.lit("-")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    ids = fx.runs(spark, d).filter(text.id_like(F.col("trace_id")) == "a hash or trace id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("trace").alias("what"), "n")
    return w.union(ids)


@query("email_values", f"""WITH {WORDS} SELECT doc_id, count(*) AS emails FROM words WHERE regexp_full_match(w,'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}') GROUP BY 1
  UNION ALL SELECT -1, count(*) FROM documents WHERE regexp_full_match(text,'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}')""")
def email_values(spark, d):
    w = words(spark, d).filter(text.is_email(F.col("w"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("emails"))
    whole = fx.table(spark, d, "documents").filter(text.is_email(F.col("text"))).agg(F.count(F.lit(1)).alias("emails")).select(F.lit(-1).cast("bigint").alias("doc_id"), "emails")
    return w.union(whole)


@query("text_rules", r"""SELECT page_id, CASE WHEN regexp_full_match(url,'[A-Za-z0-9_.:-]{1,128}') THEN url ELSE '(unusable name)' END AS usable,
  CASE WHEN length(url)>120 THEN left(url,117)||'...' ELSE url END AS excerpt, string_split('1.'||page_id||'+build','+')[1] AS version,
  'runs.p'||page_id||'.a' AS source, url='http://x' OR starts_with(url,'http:/') AS home, 'see p'||page_id||' and ' AS planted,
  CASE WHEN regexp_full_match('k:'||(page_id%7),'k:[0-9]') AND page_id%7<>3 THEN true ELSE false END AS label FROM pages""")
def text_rules(spark, d):
    p, url = fx.table(spark, d, "pages"), F.col("url")
    planted = text.plant_canaries(F.concat(F.lit("see p"), "page_id", F.lit(" @canary:first@canary:other")), {"first": "and "})
    label = F.when(F.col("page_id") % 7 == 3, F.lit("K:3")).otherwise(F.concat(F.lit("k:"), F.col("page_id") % 7))
    return p.select("page_id", text.usable_name(url).alias("usable"), text.body_excerpt(url).alias("excerpt"),
                    text.registry_version(F.concat(F.lit("1."), "page_id", F.lit("+build"))).alias("version"),
                    text.source_name(F.concat(F.lit("runs/p"), "page_id", F.lit("/a.open.jsonl"))).alias("source"),
                    text.under_home(F.concat(F.lit("/"), url), "/http:").alias("home"), planted.alias("planted"), text.valid_label(label).alias("label"))


@query("text_excerpts", r"""SELECT doc_id, CASE WHEN length(t)=0 THEN '(none)' WHEN length(t)>160 THEN left(t,157)||'...' ELSE t END AS line FROM
  (SELECT doc_id, trim(regexp_replace(text,'\s+',' ','g')) AS t FROM documents)""")
def text_excerpts(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text")).alias("line"))


def document_lines(spark, d):
    """Each document as a log request whose attributes hold what a scrub must drop."""
    doc = fx.spread(fx.table(spark, d, "documents")).selectExpr(
        "doc_id", r"regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}', 0) AS mail", "text", "lang", "source")
    rec = "named_struct('eventName', 'doc', 'attributes', array({}))".format(", ".join([
        _kv("note", "text"), _kv("cwd", "source"), _kv("lang", "lang"), _kv("user.id", "cast(doc_id as string)"), _kv("who", "mail"), _kv("dir", "concat('/home/', lang, '/x')")]))
    return doc.selectExpr(_line("resourceLogs", "scopeLogs", "logRecords", [_kv(cv.SERVICE_NAME, "'tool'")], rec) + " AS line", "doc_id")


@query("scrub_lines", r"""SELECT doc_id, 'note,lang'||CASE WHEN regexp_extract(text,'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')='' THEN ',who' ELSE '' END
  ||CASE WHEN lang<>'en' THEN ',dir' ELSE '' END AS kept, length(text) AS note_chars FROM documents""")
def scrub_lines(spark, d):
    out = governance.scrub(parse_lines(document_lines(spark, d), "logs", whole=True), home="/home/en")
    a = F.col("resourceLogs")[0]["scopeLogs"][0]["logRecords"][0]["attributes"]
    return out.select("doc_id", F.array_join(F.transform(a, lambda x: x["key"]), ",").alias("kept"),
                      F.length(F.get(a, F.lit(0))["value"]["stringValue"]).cast("bigint").alias("note_chars"))


def _hmac_sql(key: bytes, v: str) -> str:
    """HMAC-SHA-256 by its definition, in SQL."""
    pad = lambda b: bytes(x ^ b for x in key.ljust(64, bytes(1))).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || {v})))"


ACCOUNT_KEY = bytes(range(32))


@query("account_hashes", f"""SELECT c_custkey, substr({_hmac_sql(ACCOUNT_KEY, f"encode('{cv.ACCOUNT_KEY_LABEL}')")}, 1, 8) || ':' ||
  {_hmac_sql(ACCOUNT_KEY, "encode(c_custkey::VARCHAR)")} AS account FROM customer""")
def account_hashes(spark, d):
    """Customers' ids under a fixed test key."""
    c = fx.table(spark, d, "customer")
    return c.select("c_custkey", text.account_hash(F.col("c_custkey").cast("string"), ACCOUNT_KEY).alias("account"))


@query("stamped_lines", f"""WITH {fx.RUNS_SQL}, m AS (SELECT DISTINCT item_key FROM runs WHERE substr(item_key, 6)::BIGINT % 3 <> 0)
  SELECT trace_id, CASE WHEN m.item_key IS NOT NULL THEN 'lane-'||r.item_key END AS lane, CASE WHEN m.item_key IS NULL THEN '{cv.NO_MANIFEST}' END AS warning,
  'run' AS provenance, 'pool' AS collector FROM runs r LEFT JOIN m USING (item_key)""")
def stamped_lines(spark, d):
    """Every run line stamped; two runs in three have a manifest, and the sender's lane never counts."""
    from tracehold.sources.dims import run_manifests
    o = fx.table(spark, d, "orders")
    lines = run_lines(spark, d).withColumn("name", F.concat(F.lit("cust"), F.regexp_extract("line", r"cust#(\d+)", 1))).withColumn("class", F.lit("run"))
    who = o.select("o_custkey").distinct().filter(F.col("o_custkey") % 3 != 0)
    run = F.concat(F.lit("cust"), "o_custkey")
    docs = who.select(run.alias("run"), F.to_json(F.struct(run.alias("run"), F.concat(F.lit("lane-cust#"), "o_custkey").alias("lane"))).alias("value"))
    out = governance.stamp(parse_lines(lines, "traces", whole=True), run_manifests(docs), "pool")
    r = F.col("resourceSpans")[0]
    get = lambda k: F.get(F.filter(r["resource"]["attributes"], lambda a: a["key"] == k), F.lit(0))["value"]["stringValue"]
    return out.select(F.lower(r["scopeSpans"][0]["spans"][0]["traceId"]).alias("trace_id"), get(cv.LANE).alias("lane"), "warning",
                      get(cv.PROVENANCE).alias("provenance"), get(cv.COLLECTOR_ID).alias("collector"))


@query("stream_run_counts", f"""WITH {fx.RUNS_SQL} SELECT date_trunc('hour',time) AS hour, coalesce(lane,'{cv.BY_HAND}') AS lane,
  coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome, count(*) AS runs FROM runs GROUP BY 1,2,3""")
def stream_run_counts(spark, d):
    """The run counters as a stream over the orders, read to its end; the last count of each group."""
    from tracehold.streaming.live import run_counts
    out, ck = scratch(spark, "counts"), scratch(spark, "counts-ck")
    o = fx.table(spark, d, "orders").schema
    live = spark.readStream.schema(o).option("pathGlobFilter", "orders.parquet").parquet(d)
    spans = live.select(F.lit(cv.RUN_SPAN).alias("name"), F.col("o_orderdate").alias("time"),
                        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("lane"),
                        F.when(F.col("o_orderstatus") == "F", "converged").when(F.col("o_orderstatus") == "O", "budget").alias("outcome"))

    def keep(batch, n):
        batch.withColumn("n", F.lit(n)).write.mode("append").parquet(out)
    run_counts(spans).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("hour", "lane", "outcome").agg(F.max_by("runs", "n").alias("runs"))


@query("stream_dedupe", f"WITH {fx.STEPS_SQL} SELECT record_id, trace_id, span_id FROM steps")
def stream_dedupe(spark, d):
    """The delivered step spans as a stream, each record once by Spark's own state."""
    out, ck = scratch(spark, "hot"), scratch(spark, "hot-ck")
    schema = fx.table(spark, d, "lineitem").schema
    live = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    trace, span = hexed(F.col("l_orderkey"), 32), hexed(F.col("l_orderkey") * 8 + F.col("l_linenumber") + (1 << 40), 16)
    rows = live.select(F.concat(trace, F.lit("/"), span).alias("record_id"), trace.alias("trace_id"), span.alias("span_id"), F.col("l_shipdate").alias("time"))
    (rows.withWatermark("time", "3650 days").dropDuplicatesWithinWatermark(["record_id"]).drop("time").writeStream.format("parquet")
     .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


@query("store_roundtrip_runs", f"""WITH {fx.RUNS_SQL} SELECT coalesce(lane,'{cv.BY_HAND}') AS lane, coalesce(outcome,'{cv.NO_OUTCOME}') AS outcome,
  count(*) AS runs, round(median(duration_ms)/1000,1) AS median_s, round(sum(cost_usd::DECIMAL(38,9)),4)::DOUBLE AS cost_usd, max(time) AS last FROM runs GROUP BY 1,2""")
def store_roundtrip_runs(spark, d):
    """Every order shipped twice as gzip batches in three receipt hours, compacted with one hour's
    batches arriving late, and asked by name: parts and uncovered batches give the tables' own answer."""
    import datetime as dt

    from tracehold.plans import catalogue
    from tracehold.plans.store import Store
    from tracehold.streaming.ship import write_batch
    root = scratch(spark, "store")
    lines = run_lines(spark, d).withColumn("class", F.lit("service")).withColumn("name", F.lit("svc")).withColumn("status", F.lit("ok")).withColumn("signal", F.lit("traces"))
    none = spark.createDataFrame([], "run string, valid boolean, lane string, harness string, focus string, item string, step string, budget bigint")
    day = dt.datetime(2026, 10, 5)
    store = Store(spark, root)
    write_batch(lines, none, root, "c1", "first", received=day.replace(hour=8))
    write_batch(lines, none, root, "c1", "again", received=day.replace(hour=8, minute=20))
    store.compact(day.replace(hour=12), lookback=dt.timedelta(hours=12))
    write_batch(lines, none, root, "c2", "late", received=day.replace(hour=8, minute=40))
    spans = store.table("traces", [day.replace(hour=h) for h in (7, 8, 9)])
    return catalogue.runs(spans, fx.SINCE, fx.UNTIL)
