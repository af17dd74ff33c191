import json

import pytest
from pyspark.sql import functions as F

from otlp import NOW, event, metric, span
from tracehold import conventions as cv
from tracehold.operators import quality as q
from tracehold.operators import reports
from tracehold.sources import dims
from tracehold.sources.batches import parse_lines

TRACE, ROOT = "ab" * 16, "cd" * 8
SPEC = q.Spec("ynt", expected_outcome="converged")
RES = {cv.SERVICE_NAME: "ynt", cv.SERVICE_VERSION: "1.0", "service.instance.id": "i1", "conformance.marker": "m1"}
REG = {"tool": "ynt", "version": "1.0", "attributes": [{"id": "ynt.outcome", "type": "string"}, {"id": "ynt.kind", "type": "string"}],
       "standard_attributes": [], "spans": [{"name": "ynt.run"}], "events": [{"name": "ynt.run.started"}],
       "metrics": [{"name": "ynt.runs", "attributes": [{"name": "ynt.kind", "cardinality": 2}]}]}


def good():
    """Lines of a conforming tool by signal."""
    return {"traces": [span(TRACE, "1" * 16, "ynt.run", NOW, resource=RES, attributes={"ynt.outcome": "converged"}, parent=ROOT, status=1)],
            "logs": [event("ynt.run.started", NOW, resource=RES, trace=TRACE, sid="1" * 16)],
            "metrics": [metric("ynt.runs", 1, 1.0, NOW, resource=RES, attributes={"ynt.kind": "a"})]}


def checks(spark, lines, dest="spool"):
    frames = {}
    for s in ("traces", "logs", "metrics"):
        df = spark.createDataFrame([(l,) for l in lines.get(s, [])], "line string")
        for c, v in (("scenario", "s"), ("run_kind", "spool"), ("destination", dest), ("writer", "local")):
            df = df.withColumn(c, F.lit(v))
        frames[s] = parse_lines(df, s)
    c = q.capture(frames["traces"], frames["logs"], frames["metrics"], keep=("scenario", "run_kind", "destination", "writer"))
    runs = spark.createDataFrame([("s", "spool", "m1", TRACE, ROOT)], "scenario string, run_kind string, marker string, expected_trace_id string, expected_span_id string")
    reg = dims.registry_names(spark.createDataFrame([(json.dumps(REG),)], "value string"))
    limits = reg.filter("kind = 'limit'").select("metric", F.col("name").alias("attr"), "limit")
    return q.run_checks(c, runs, reg, limits, SPEC)


def failed(spark, **change):
    lines = {**good(), **change}
    return {r.rule for r in checks(spark, lines).collect() if r.status == "fail"}


def test_conforming(spark):
    got = checks(spark, good())
    assert {r.rule: r.status for r in got.collect()} == {1: "pass", 2: "pass", 3: "pass", 4: "skipped", 5: "pass", 7: "pass", 8: "pass", 11: "pass"}
    assert {(r.rule, r.status) for r in q.summarise(got).collect()} >= {(1, "pass"), (4, "skipped")} and q.verdict(got).first().ok


def one(name="ynt.run", res=RES, attrs=None, trace=TRACE, parent=ROOT, status=1):
    return span(trace, "1" * 16, name, NOW, resource=res, attributes={"ynt.outcome": "converged"} if attrs is None else attrs, parent=parent, status=status)


@pytest.mark.parametrize("rule,change", [
    (2, lambda: {"traces": [one(res={**RES, "service.instance.id": ""})]}),
    (2, lambda: {"traces": [one(res={**RES, "conformance.marker": "other"})]}),
    (3, lambda: {"traces": [one(), one(trace="ee" * 16)]}),
    (4, lambda: {"traces": [one(), span("ee" * 16, "2" * 16, "v", NOW, resource={cv.SERVICE_NAME: "vendor"})]}),
    (5, lambda: {"logs": []}),
    (7, lambda: {"traces": [one(attrs={"ynt.outcome": "converged", "ynt.secret": "1"})]}),
    (8, lambda: {"metrics": [metric("ynt.runs", 1, 1.0, NOW, resource=RES, attributes={"ynt.kind": "0123456789abcdef0"})]}),
    (8, lambda: {"metrics": [metric("ynt.runs", 1, 1.0, NOW, resource=RES, attributes={"ynt.kind": k}) for k in "abc"]}),
    (11, lambda: {"traces": [one(attrs={})]}),
    (11, lambda: {"traces": [one(attrs={"ynt.outcome": "budget"})]})])
def test_each_fault_fails_its_rule(spark, rule, change):
    assert rule in failed(spark, **change())


def test_routing_and_kill(spark):
    runs = spark.createDataFrame([("s", "neither", False, False), ("s", "kill", False, False)], "scenario string, run_kind string, exited_early boolean, timed_out boolean")
    c = spark.createDataFrame([("s", "neither", "stray", "span", "x", "ynt")], "scenario string, run_kind string, destination string, kind string, name string, service string").withColumn("trace_id", F.lit("t"))
    assert [(r.status) for r in q.routing(c, runs.select("scenario", "run_kind"), SPEC).collect()] == ["fail"]
    torn = spark.createDataFrame([("s", "kill", "a.jsonl")], "scenario string, run_kind string, path string")
    assert q.survives_kill(c, runs, torn, SPEC).first().status == "fail"
    assert q.survives_kill(c, runs, torn.filter("false"), SPEC).first().detail == "0 started events, 0 torn files"
    files = spark.createDataFrame([("a", b"x\n"), ("b", b"x\ny"), ("c", b"")], "path string, content binary")
    assert [r.path for r in q.torn_files(files).collect()] == ["b"]
    base = [("s", "spool", 0, 100.0, False), ("s", "hung", 0, 190.0, False), ("s", "unwritable", 1, 90.0, False), ("t", "hung", 0, 1.0, False)]
    timed = spark.createDataFrame(base, "scenario string, run_kind string, exit_code int, duration_ms double, timed_out boolean")
    assert {(r.scenario, r.name[14:]): r.status for r in q.never_blocks(timed, 50, 50).collect()} == {("s", "hung"): "pass", ("s", "unwritable"): "fail", ("t", "hung"): "skipped"}


def test_canaries_by_brute_force(spark):
    words = ["alpha", "béta", "gamma", "x1", "delta-7", "a.b", "%%"]
    texts = [" ".join(words[(i * k + k) % 7] for k in range(1, 9)) + ("tail" if i % 3 else "") for i in range(60)] + ["", "y" * 5000 + "alphabet soup"]
    tokens = [("one", "gamma"), ("sub", "lph"), ("two", "alpha béta"), ("three", "x1 gamma alpha"), ("punct", "delta-7 a.b %%"), ("none", "absent here now"), ("sym", "%%")]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_key int, line string").repartition(5)
    want = {(i, k) for i, t in enumerate(texts) for k, tok in tokens if tok in t}
    for chunk in (1, 256):
        hits = q.scan_canaries(lines, spark.createDataFrame(tokens, "kind string, token string"), chunk=chunk).collect()
        assert {(r.line_key, r.kind) for r in hits} == want and len(hits) == len(want)
    assert all("<canary:" + r.kind + ">" in r.snippet for r in hits)
    res = q.canary_check(lines.withColumn("scenario", F.lit("s")), spark.createDataFrame([(1, "one", "")], "line_key int, kind string, snippet string"))
    assert res.first().status == "fail"


def test_store_unchanged_and_diffs(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "line string")
    b = spark.createDataFrame([("x",), ("z",)], "line string")
    assert sorted((r.line, r.side, r.times) for r in q.multiset_diff(a, b).collect()) == [("x", "left", 1), ("y", "left", 1), ("z", "right", 1)]
    none = spark.createDataFrame([], "line_key int")
    assert q.store_unchanged(a, a, none, "s").first().status == "pass" and q.store_unchanged(a, b, none, "s").first().detail == "1 added, 2 removed, 0 planted"


def test_views(spark):
    runs = spark.createDataFrame([("fix", "converged", 3, 90.0, 1.0, NOW), ("fix", "budget", 1, None, 0.5, NOW)],
                                 "lane string, outcome string, runs bigint, median_s double, cost_usd double, last timestamp")
    r = reports.lane_summary(runs).first()
    assert (r.runs, r.converged, r.yield_pct, r.cost_usd, r.median_s) == (4, 3, 75.0, 1.5, 90.0)
    t = spark.sql("SELECT 't' trace_id, timestamp'2026-10-05 00:00:00' time, 120000D duration_ms UNION ALL SELECT 't', timestamp'2026-10-05 00:00:30', 60000D")
    assert sorted((r.left_pct, r.width_pct) for r in reports.waterfall(t).collect()) == [(0.0, 100.0), (25.0, 50.0)]


def test_retention(spark):
    import datetime as dt
    now = dt.datetime(2026, 10, 5, 12)
    key = lambda t, n: (f"traces/{t:%Y/%m/%d/%H}/c1/{n:026d}_s-0-1.jsonl.gz", 40)
    rows = [key(now - dt.timedelta(days=d), d) for d in range(1, 9)] + [("rollups/runs/daily/2024-01-01.parquet", 5), ("rollups/runs/monthly/2026-01.parquet", 5),
            ("registries/x", 99), (f"compacted/traces/{now:%Y/%m/%d/%H}/part-1.parquet", 40), (f"index/items/{now:%Y/%m/%d}.parquet", 40)]
    plan = reports.retention_plan(spark.createDataFrame(rows, "key string, size bigint"), now, dt.timedelta(days=6), max_bytes=200)
    got = sorted((r.reason, r.key.split("/")[3] if r.key.startswith("traces") else r.key) for r in plan.collect())
    assert got == [("age", "27"), ("age", "28"), ("age", "rollups/runs/daily/2024-01-01.parquet"), ("size", "01"), ("size", "29"), ("size", "30")]


def test_a_tool_that_wrote_nothing(spark):
    """Its spool run fails rule 3; rules without anything to judge are skipped, not passed."""
    runs = spark.createDataFrame([("quiet", "spool", "m", "t1", "s1")], "scenario string, run_kind string, marker string, expected_trace_id string, expected_span_id string")
    attrs = "array<struct<k:string,v:string>>"
    c = spark.createDataFrame([], f"kind string, name string, service string, resource {attrs}, attributes {attrs}, trace_id string, span_id string, parent_span_id string, status string, scenario string, run_kind string, destination string, writer string")
    reg = spark.createDataFrame([], "tool string, version string, kind string, name string, is_template boolean")
    limits = spark.createDataFrame([], "metric string, attr string, limit bigint")
    got = lambda df: [(r.rule, r.status) for r in df.orderBy("rule").collect()]
    assert got(q.resource(c, runs, SPEC)) == [(2, q.SKIPPED)]
    assert got(q.joins_trace(c, runs, SPEC)) == [(3, q.FAIL), (4, q.SKIPPED)]
    assert got(q.declared_names(c, reg, SPEC, runs)) == [(7, q.SKIPPED)]
    assert got(q.cardinality_check(c, limits, SPEC, runs)) == [(8, q.SKIPPED)]
