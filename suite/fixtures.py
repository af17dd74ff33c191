"""The driver's tables read as telemetry: the same projections for Spark and as SQL for the check.

orders are runs, lineitem are the runs' child spans (delivered more than once), events are log
records and metric points, documents are raw lines, benchmark holds planted strings, conversations
are traces of turns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracehold import conventions as cv
from tracehold.schemas import ATTRS
from tracehold.session import prepare

SINCE, UNTIL = dt.datetime(1990, 1, 1), dt.datetime(2030, 1, 1)

_L, _S, _D, _I, _TS = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()
SCHEMAS: dict[str, dict[str, T.DataType]] = {
    "orders": dict(o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_TS, o_orderpriority=_S),
    "lineitem": dict(l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D, l_extendedprice=_D,
                     l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S, l_shipdate=_TS),
    "events": dict(event_id=_L, ts=_TS, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": dict(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "benchmark": dict(item_id=_L, text=_S),
    "labels": dict(doc_id=_L, quality=_I, toxic=_I),
    "conversations": dict(conv_id=_L, turn=_L, role=_S, text=_S),
    "pages": dict(page_id=_L, url=_S, html=_S),
    "customer": dict(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "part": dict(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    schema = T.StructType([T.StructField(n, t) for n, t in SCHEMAS[name].items()])
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores, spread before costly parsing; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def hex_id(key: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(key)), width, "0")


def attr_list(**pairs: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs.items()]).cast(ATTRS)


def pairs(items: list[tuple[str, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in items]).cast(ATTRS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as run spans."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ms = (k % 997 * 100)
    return o.select(
        F.concat(hex_id(k, 32), F.lit("/"), hex_id(k, 16)).alias("record_id"),
        F.col("o_orderdate").alias("time"),
        F.timestamp_millis(F.unix_millis("o_orderdate") + ms).alias("end_time"),
        ms.cast("double").alias("duration_ms"), hex_id(k, 32).alias("trace_id"), hex_id(k, 16).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"), F.lit(cv.RUN_SPAN).alias("name"),
        F.lit("internal").alias("kind"), F.when(F.col("o_orderstatus") == "O", "error").otherwise("ok").alias("status"),
        F.lit("runner").alias("service"), F.concat(F.lit("cust#"), "o_custkey").alias("item_key"),
        F.concat(F.lit("step"), k % 5).alias("step_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("lane"),
        F.concat(F.lit("h"), k % 3).alias("harness"), F.concat(F.lit("repo"), F.col("o_custkey") % 11).alias("repo"),
        F.when(F.col("o_orderstatus") == "F", "converged").when(F.col("o_orderstatus") == "O", "budget").alias("outcome"),
        F.concat(F.lit("c"), "o_custkey").alias("actor"),
        F.when(k % 7 != 6, F.concat(F.lit("m"), k % 7)).alias("model"),
        F.create_map(F.lit("team"), F.concat(F.lit("t"), F.col("o_custkey") % 5).cast("string"),
                     F.lit("tier"), F.concat(F.lit("p"), k % 2).cast("string")).alias("labels"),
        (F.col("o_totalprice") / 1000).alias("cost_usd"),
        pairs([(cv.USER_NAME, F.concat(F.lit("c"), "o_custkey")), (cv.INPUT_TOKENS, 1000 + k % 500),
               (cv.OUTPUT_TOKENS, 200 + k % 100)]).alias("attributes"),
        pairs([(cv.SERVICE_NAME, F.lit("runner"))]).alias("resource"),
        F.concat(F.lit("b"), k % 16).alias("file"))


RUNS_SQL = f"""runs AS (SELECT lpad(lower(to_hex(o_orderkey)),32,'0')||'/'||lpad(lower(to_hex(o_orderkey)),16,'0') AS record_id,
  o_orderdate AS time, lpad(lower(to_hex(o_orderkey)),32,'0') AS trace_id, lpad(lower(to_hex(o_orderkey)),16,'0') AS span_id,
  NULL::VARCHAR AS parent_span_id, '{cv.RUN_SPAN}' AS name, 'runner' AS service,
  CASE WHEN o_orderstatus='O' THEN 'error' ELSE 'ok' END AS status,
  'cust#'||o_custkey AS item_key, 'step'||(o_orderkey%5) AS step_id,
  CASE WHEN o_orderpriority<>'5-LOW' THEN o_orderpriority END AS lane,
  'h'||(o_orderkey%3) AS harness, 'repo'||(o_custkey%11) AS repo,
  CASE o_orderstatus WHEN 'F' THEN 'converged' WHEN 'O' THEN 'budget' END AS outcome,
  'c'||o_custkey AS actor, CASE WHEN o_orderkey%7<>6 THEN 'm'||(o_orderkey%7) END AS model,
  't'||(o_custkey%5) AS team, 'p'||(o_orderkey%2) AS tier,
  o_totalprice/1000 AS cost_usd, ((o_orderkey%997)*100)::DOUBLE AS duration_ms,
  1000+o_orderkey%500 AS input_tokens, 200+o_orderkey%100 AS output_tokens, 'b'||(o_orderkey%16) AS file
  FROM orders)"""


def steps_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as step spans, as delivered: (order, line) repeats, in different files."""
    l = table(spark, sf_dir, "lineitem")
    order, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    root = hex_id(order, 16)
    return l.select(
        F.concat(hex_id(order, 32), F.lit("/"), hex_id(order * 8 + line + (1 << 40), 16)).alias("record_id"),
        F.col("l_shipdate").alias("time"), F.col("l_quantity").alias("duration_ms"), hex_id(order, 32).alias("trace_id"),
        hex_id(order * 8 + line + (1 << 40), 16).alias("span_id"),
        F.when(line > 3, hex_id(order * 8 + 1 + (1 << 40), 16)).otherwise(root).alias("parent_span_id"),
        F.concat(F.lit("step."), "l_returnflag").alias("name"), F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("service"),
        F.when(F.col("l_linestatus") == "F", "ok").otherwise("error").alias("status"),
        F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "accepted").alias("outcome"),
        F.lit(None).cast("string").alias("actor"), F.lit("client").alias("kind"),
        F.col("l_extendedprice").alias("cost_usd"), F.concat(F.lit("b"), "l_suppkey").alias("file"),
        "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")


STEP_ORDER = ["file", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "status", "name"]

STEPS_SQL = """copies AS (SELECT lpad(lower(to_hex(l_orderkey)),32,'0')||'/'||lpad(lower(to_hex(l_orderkey*8+l_linenumber+1099511627776)),16,'0') AS record_id,
  l_shipdate AS time, l_quantity AS duration_ms, lpad(lower(to_hex(l_orderkey)),32,'0') AS trace_id,
  lpad(lower(to_hex(l_orderkey*8+l_linenumber+1099511627776)),16,'0') AS span_id,
  CASE WHEN l_linenumber>3 THEN lpad(lower(to_hex(l_orderkey*8+1+1099511627776)),16,'0') ELSE lpad(lower(to_hex(l_orderkey)),16,'0') END AS parent_span_id,
  'step.'||l_returnflag AS name, 's'||(l_suppkey%4) AS service, CASE WHEN l_linestatus='F' THEN 'ok' ELSE 'error' END AS status,
  CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'accepted' END AS outcome, NULL::VARCHAR AS actor,
  l_extendedprice AS cost_usd, 'b'||l_suppkey AS file, l_partkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem),
steps AS (SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY record_id
  ORDER BY file, l_partkey, l_quantity, l_extendedprice, l_shipdate, status, name)=1)"""


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log records that carry an event name."""
    e, k = table(spark, sf_dir, "events"), F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").cast("string").alias("record_id"), F.col("ts").alias("time"), F.col("event_type").alias("event"),
        hex_id(F.col("user_id"), 32).alias("trace_id"), hex_id(F.col("event_id"), 16).alias("span_id"),
        F.lit("tool").alias("service"), F.concat(F.lit("u"), "user_id").alias("actor"),
        F.when(F.col("event_type") == "error", "failed").alias("outcome"),
        F.concat(F.lit("cust#"), "user_id").alias("item_key"), F.concat(F.lit("step"), F.col("user_id") % 3).alias("step_id"),
        F.create_map(F.lit("k"), k).alias("labels"), F.col("value"), pairs([("k", k)]).alias("attributes"),
        F.concat(F.lit("f"), F.col("event_id") % 8).alias("file"))


LOGS_SQL = """logs AS (SELECT event_id::VARCHAR AS record_id, ts AS time, event_type AS event,
  lpad(lower(to_hex(user_id)),32,'0') AS trace_id, lpad(lower(to_hex(event_id)),16,'0') AS span_id, 'tool' AS service, 'u'||user_id AS actor,
  CASE WHEN event_type='error' THEN 'failed' END AS outcome, 'cust#'||user_id AS item_key, 'step'||(user_id%3) AS step_id,
  json_extract_string(props,'$.k') AS k, value, 'f'||(event_id%8) AS file FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as metric points: a kind of metric per event type."""
    e = table(spark, sf_dir, "events")
    t, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint") % 5
    return e.select(
        F.col("event_id").cast("string").alias("record_id"), F.col("ts").alias("time"),
        F.date_trunc("day", "ts").alias("start_time"), t.alias("name"), F.lit("1").alias("unit"),
        F.when(t == "view", "gauge").when(t == "signup", "histogram").otherwise("sum").alias("type"),
        F.when(t.isin("click", "error"), "delta").when(t.isin("purchase", "signup"), "cumulative").alias("temporality"),
        F.col("value"), F.when(t == "signup", F.lit(1.0)).alias("count"), F.lit("tool").alias("service"),
        pairs([("k", k)]).alias("attributes"), pairs([(cv.SERVICE_NAME, F.lit("tool"))]).alias("resource"),
        F.to_date("ts").alias("received_day"))


POINTS_SQL = """points AS (SELECT event_id, ts AS time, date_trunc('day',ts) AS start_time, event_type AS name, '1' AS unit,
  CASE event_type WHEN 'view' THEN 'gauge' WHEN 'signup' THEN 'histogram' ELSE 'sum' END AS type,
  CASE WHEN event_type IN ('click','error') THEN 'delta' WHEN event_type IN ('purchase','signup') THEN 'cumulative' END AS temporality,
  value, CASE WHEN event_type='signup' THEN 1.0 END AS count, 'tool' AS service,
  json_extract_string(props,'$.k')::BIGINT%5 AS k, ts::DATE AS received_day FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as raw spool lines: the source is the run that wrote them."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("run"), F.floor(F.col("doc_id") / 64).cast("bigint").alias("chunk"),
        F.col("text").alias("line"), "lang")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        hex_id(F.col("conv_id"), 32).alias("trace_id"), "turn", "role", "text")
