"""Contract rules and registries over captures and documents derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite.decoded import event_lines, run_lines
from suite.named import SPANS_SQL, all_spans
from suite.registry import query
from tracehold import conventions as cv
from tracehold.operators import governance, quality
from tracehold.sources import dims
from tracehold.sources.batches import parse_lines

SPEC = quality.Spec("runner", vendor_service="s0")
# A scenario is a tenth of all traces.
_SCENARIO = "'s'||(('0x'||right(trace_id,8))::BIGINT%10)"


def _capture(spark, d):
    s = all_spans(spark, d)
    return s.select(F.concat(F.lit("s"), F.conv(F.substring("trace_id", 25, 8), 16, 10).cast("bigint") % 10).alias("scenario"),
                    F.lit("spool").alias("run_kind"), F.lit("spool").alias("destination"), F.lit("span").alias("kind"), "name", "service",
                    "trace_id", "span_id", "parent_span_id", "status", "outcome")


def _runs(spark, d):
    """Every scenario was given the trace of its first order and no parent."""
    return _capture(spark, d).filter("service = 'runner'").groupBy("scenario", "run_kind").agg(
        F.min("trace_id").alias("expected_trace_id")).withColumn("expected_span_id", F.lit(None).cast("string"))


@query("contract_traces", f"""WITH {SPANS_SQL}, c AS (SELECT {_SCENARIO} AS scenario, * FROM spans),
  r AS (SELECT scenario, min(trace_id) AS t FROM c WHERE service='runner' GROUP BY 1),
  x AS (SELECT scenario, count(*) FILTER (WHERE service='runner') AS n, count(*) FILTER (WHERE service='runner' AND trace_id<>t) AS foreign_n,
   coalesce(bool_or(service='runner' AND trace_id=t AND parent_span_id IS NULL),false) AS joined,
   count(*) FILTER (WHERE service<>'runner') AS others, count(*) FILTER (WHERE service<>'runner' AND trace_id<>t) AS outside FROM c JOIN r USING (scenario) GROUP BY 1)
  SELECT scenario, 3 AS rule, 'joins the given trace: spool' AS name, CASE WHEN n=0 THEN 'fail' WHEN foreign_n>0 OR NOT joined THEN 'fail' ELSE 'pass' END AS status,
   foreign_n||' of '||n||' spans in another trace' AS detail FROM x UNION ALL
  SELECT scenario, 4, 'passes the trace on: spool', CASE WHEN others=0 THEN 'skipped' WHEN outside>0 THEN 'fail' ELSE 'pass' END,
   outside||' of '||others||' spans of started processes outside the trace' FROM x""")
def contract_traces(spark, d):
    return quality.joins_trace(_capture(spark, d), _runs(spark, d), SPEC)


@query("contract_routing", f"""WITH {SPANS_SQL}, c AS (SELECT {_SCENARIO} AS scenario, service FROM spans), k(run_kind) AS (VALUES ('spool'),('endpoint'),('neither')),
  x AS (SELECT scenario, run_kind, count(*) FILTER (WHERE run_kind='spool') AS spool, count(*) FILTER (WHERE run_kind='endpoint' AND service<>'s0') AS ep FROM c, k
   WHERE run_kind<>'neither' GROUP BY 1,2 UNION ALL SELECT DISTINCT scenario, 'neither', 0, 0 FROM c)
  SELECT scenario, 1 AS rule, 'where to write: '||run_kind AS name, CASE WHEN run_kind='spool' AND spool=0 THEN 'fail' WHEN run_kind='endpoint' AND ep=0 THEN 'fail' ELSE 'pass' END AS status,
  spool||' in the spool, '||ep||' at the endpoint, 0 stray' AS detail FROM x""")
def contract_routing(spark, d):
    """Each scenario's spans seen once in a spool run and once in an endpoint run; a third run writes nothing."""
    c = _capture(spark, d)
    where = F.explode(F.array(F.lit("spool"), F.lit("endpoint"))).alias("run_kind")
    both = c.drop("run_kind", "destination").select("*", where).withColumn("destination", F.col("run_kind"))
    kinds = c.select("scenario").distinct().select("scenario", F.explode(F.array(*[F.lit(k) for k in ("spool", "endpoint", "neither")])).alias("run_kind"))
    return quality.routing(both, kinds, SPEC)


@query("contract_never_blocks", """WITH o AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer),
  r AS (SELECT 'c'||c_custkey AS scenario, c_custkey%5 AS ex, abs(c_acctbal) AS ms FROM o)
  SELECT scenario, 12 AS rule, 'never blocks: hung' AS name, CASE WHEN ex=3 OR ms*1.5+100 > ms+500+1000 THEN 'fail' ELSE 'pass' END AS status FROM r""")
def contract_never_blocks(spark, d):
    """A customer as a scenario: its balance is how long the normal run took; with a hung endpoint it takes half as long again."""
    c = fx.table(spark, d, "customer")
    ms, ex = F.abs("c_acctbal"), (F.col("c_custkey") % 5)
    shape = lambda kind, code, took: c.select(F.concat(F.lit("c"), "c_custkey").alias("scenario"), F.lit(kind).alias("run_kind"), code.alias("exit_code"),
                                              took.alias("duration_ms"), F.lit(False).alias("timed_out"))
    runs = shape("spool", ex, ms).unionByName(shape("hung", F.when(ex == 3, F.lit(99)).otherwise(ex), ms * 1.5 + 100))
    return quality.never_blocks(runs, 500.0, 1000.0).select("scenario", "rule", "name", "status")


def _registry_docs(spark, d):
    """Each part as a registry document of its brand, a version per size; every tenth size declares a foreign name."""
    p = fx.table(spark, d, "part")
    tool, version = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.concat(F.lit("1."), F.col("p_size") % 4, F.lit("+"), "p_size")
    own = F.array(F.struct(F.concat(tool, F.lit(".a"), F.col("p_size") % 3).alias("id"), F.lit("string").alias("type")),
                  F.struct(F.when(F.col("p_size") % 10 == 0, F.lit("host.name")).otherwise(F.concat(tool, F.lit(".b"))).alias("id"), F.lit("string").alias("type")))
    return p.select(F.to_json(F.struct(tool.alias("tool"), version.alias("version"), own.alias("attributes"))).alias("value"))


_PARTS = """p AS (SELECT lower(regexp_replace(p_brand,'[^A-Za-z0-9]','','g')) AS tool, '1.'||(p_size%4)||'+'||p_size AS version, p_size FROM part)"""


@query("registry_conflicts", f"""WITH {_PARTS} SELECT tool, '1.'||(p_size%4) AS version, count(DISTINCT p_size) AS registries FROM p GROUP BY 1,2 HAVING count(DISTINCT p_size)>1""")
def registry_conflicts(spark, d):
    return dims.registry_conflicts(dims.registry_names(_registry_docs(spark, d)))


@query("registry_misdeclared", f"WITH {_PARTS} SELECT DISTINCT tool, version, 'host.name' AS name FROM p WHERE p_size%10=0")
def registry_misdeclared(spark, d):
    return dims.misdeclared(dims.registry_names(_registry_docs(spark, d)))


@query("registry_accepted", f"""WITH {_PARTS} SELECT tool, version, 'attribute' AS kind, tool||'.a'||(p_size%3) AS name FROM p WHERE p_size%10<>0 GROUP BY ALL
  UNION ALL SELECT tool, version, 'attribute', tool||'.b' FROM p WHERE p_size%10<>0 GROUP BY ALL""")
def registry_accepted(spark, d):
    return dims.accepted_names(dims.registry_names(_registry_docs(spark, d))).select("tool", "version", "kind", "name").distinct()


@query("vendor_names", f"""SELECT '{cv.RUN_OUTCOME}' AS name, count(*) AS count FROM orders UNION ALL SELECT '{cv.RUN_COST}', count(*) FROM orders
  UNION ALL SELECT '{cv.USER_NAME}', count(*) FROM orders""")
def vendor_names(spark, d):
    """Attribute names of the order spans that a pinned list of the token and model names lacks."""
    pinned = spark.createDataFrame([(cv.INPUT_TOKENS,), (cv.OUTPUT_TOKENS,), (cv.RESPONSE_MODEL,)], "name string")
    return governance.unknown_vendor_names(parse_lines(run_lines(spark, d), "traces", whole=True), pinned, "fixture")


@query("name_check", """SELECT 'tool' AS service, '' AS version, event_type AS name, count(*) AS count, false AS overflow FROM events WHERE event_type NOT IN ('click','view') GROUP BY event_type
  UNION ALL SELECT 'tool', '', 'event.name', count(*), false FROM events""")
def name_check(spark, d):
    """Event lines against a registry that declares the click event and attribute k."""
    names = [("event", "click", False), ("attribute", "k", False)]
    registry = spark.createDataFrame([("tool", "", k, n, t) for k, n, t in names], "tool string, version string, kind string, name string, is_template boolean")
    return governance.check_names(parse_lines(event_lines(spark, d), "logs", whole=True), registry)
