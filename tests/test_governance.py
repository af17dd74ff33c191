import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from otlp import NOW, attrs, event, metric, span
from tracehold import conventions as cv
from tracehold.operators import governance as g
from tracehold.sources import dims
from tracehold.sources.batches import parse_lines


def raw(spark, signal, *lines, **cols):
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return parse_lines(df, signal, whole=True)


def flat(kvs):
    return {a["key"]: next((v for v in a["value"].values() if v is not None), None) for a in json.loads(kvs)}


def resource(df, column="resourceSpans"):
    return [flat(r[0]) for r in df.select(F.to_json(F.col(column)[0]["resource"]["attributes"])).collect()]


def test_stamp(spark):
    manifests = spark.createDataFrame([("r1", json.dumps({"run": "r1", "lane": "fix", "item": "I-1"})), ("r2", json.dumps({"run": "x", "lane": "fix"}))], "run string, value string")
    m = dims.run_manifests(manifests)
    line = span("aa", "b", "s", NOW, resource={cv.LANE: "forged", cv.PROVENANCE: "forged", "keep": "1"})
    df = raw(spark, "traces", line).crossJoin(spark.createDataFrame(
        [("run", "r1"), ("run", "r2"), ("run", "r3"), ("local", "")], "class string, name string"))
    got = {(r["name"], r["class"]): flat(r["a"]) for r in g.stamp(df, m, "pool", "job9", F.to_timestamp(F.lit("2026-10-05 21:30:00"))).select(
        "name", "class", F.to_json(F.col("resourceSpans")[0]["resource"]["attributes"]).alias("a")).collect()}
    assert got[("r1", "run")] == {"keep": "1", cv.PROVENANCE: "run", cv.COLLECTOR_ID: "pool", cv.COLLECTOR_INSTANCE: "job9",
                                  cv.RECEIVED_AT: "2026-10-05T21:30:00.000Z", cv.RUN_ID: "r1", cv.LANE: "fix", cv.ITEM_KEY: "I-1"}
    assert got[("r2", "run")][cv.PROVENANCE_WARNING] == cv.BAD_MANIFEST and cv.LANE not in got[("r2", "run")]
    assert got[("r3", "run")][cv.PROVENANCE_WARNING] == cv.NO_MANIFEST
    assert got[("", "local")][cv.LANE] == "forged" and cv.PROVENANCE_WARNING not in got[("", "local")]


def test_scrub(spark):
    key = bytes(range(32))
    line = span("aa", "b", "s", NOW, resource={"user.email": "x", "cwd": "/w", "user.id": "u1", "ok": "fine"},
                attributes={"mail": "a@b.example.org", "said": "mail a@b.example.org", "path": "/home/al/x", "near": "/home/alan", "n": 5,
                            "list": ["x", "/home/al"], "list2": ["x", "y"], "map": {"host.name": "h", "k": "v", "deep": {"cwd": "c", "z": "1"}},
                            "lm": [{"cwd": "c", "q": "r"}], "too": {"a": {"b": {"c": "d"}}}},
                events=[{"name": "e", "attributes": attrs({"tool_input": "t", "k": "v"})}], links=[{"traceId": "1", "attributes": attrs({"cwd": "c"})}])
    df = raw(spark, "traces", line)
    out = g.scrub(df, "/home/al", key, {"team": "t"})
    row = out.select(F.to_json(F.col("resourceSpans")[0]["resource"]["attributes"]).alias("r"),
                     F.to_json(F.col("resourceSpans")[0]["scopeSpans"][0]["spans"][0]).alias("s")).first()
    hashed = hmac.new(key, cv.ACCOUNT_KEY_LABEL.encode(), hashlib.sha256).hexdigest()[:8] + ":" + hmac.new(key, b"u1", hashlib.sha256).hexdigest()
    assert flat(row.r) == {"user.id": hashed, "ok": "fine", "team": "t"}
    s = json.loads(row.s)
    a = {x["key"]: x.get("value") for x in s["attributes"]}
    assert list(a) == ["said", "near", "n", "list2", "map", "lm", "too"]
    m = {x["key"]: x["value"] for x in a["map"]["kvlistValue"]["values"]}
    assert list(m) == ["k", "deep"] and [x["key"] for x in m["deep"]["kvlistValue"]["values"]] == ["z"]
    assert [x["key"] for x in a["lm"]["arrayValue"]["values"][0]["kvlistValue"]["values"]] == ["q"]
    assert a["too"]["kvlistValue"]["values"][0]["value"]["kvlistValue"]["values"] == []   # deeper than parsed: dropped
    assert [x["key"] for x in s["events"][0]["attributes"]] == ["k"] and s["links"][0]["attributes"] == [] and s["name"] == "s"
    assert g.scrub_counts(df, g.scrub(df, "/home/al", key)).first().stripped == 11
    assert resource(g.scrub(df)) == [{"ok": "fine"}]   # without a key an account id goes
    for bad in [{"cwd": "x"}, {"k": ""}, {"k": "a@b.example.org"}, {"k": "/home/al/x"}]:
        with pytest.raises(ValueError):
            g.scrub(df, "/home/al", override=bad)
    m = g.scrub(raw(spark, "metrics", metric("m", 1, 2.0, NOW, attributes={"cwd": "c", "k": "v"})))
    assert flat(m.select(F.to_json(F.col("resourceMetrics")[0]["scopeMetrics"][0]["metrics"][0]["sum"]["dataPoints"][0]["attributes"])).first()[0]) == {"k": "v"}
    l = g.scrub(raw(spark, "logs", event("e", NOW, attributes={"host.ip": "c", "k": "v"})))
    assert flat(l.select(F.to_json(F.col("resourceLogs")[0]["scopeLogs"][0]["logRecords"][0]["attributes"])).first()[0]) == {"k": "v"}


REGISTRY = {"tool": "ynt", "version": "1.0", "attributes": [
    {"id": "ynt.a", "type": "string", "annotations": {cv.CARDINALITY: 3}}, {"id": "ynt.label.<key>", "type": "template[string]"}],
    "standard_attributes": ["http.method"], "spans": [{"name": "ynt.run"}], "events": [{"name": "ynt.started"}],
    "metrics": [{"name": "ynt.m", "attributes": [{"name": "ynt.a"}, {"name": "http.method", "cardinality": 2}, {"name": "free"}]}]}


def registry(spark, *docs):
    return dims.registry_names(spark.createDataFrame([(json.dumps(d),) for d in (docs or (REGISTRY,))], "value string"))


def test_registry(spark):
    reg = registry(spark)
    got = {(r.kind, r.name, r.metric, r.limit, r.is_template) for r in reg.collect()}
    assert got == {("attribute", "ynt.a", None, 3, False), ("attribute", "ynt.label.", None, None, True), ("standard", "http.method", None, None, False),
                   ("span", "ynt.run", None, None, False), ("event", "ynt.started", None, None, False), ("metric", "ynt.m", None, None, False),
                   ("limit", "ynt.a", "ynt.m", 3, False), ("limit", "http.method", "ynt.m", 2, False)}
    other = {**REGISTRY, "version": "1.0+x", "attributes": [{"id": "host.name", "type": "string"}]}
    both = registry(spark, REGISTRY, other)
    assert [(r.tool, r.version, r.registries) for r in dims.registry_conflicts(both).collect()] == [("ynt", "1.0", 2)]
    assert [(r.version, r.name) for r in dims.misdeclared(both).collect()] == [("1.0+x", "host.name")]
    assert {r.version for r in dims.accepted_names(both).collect()} == {"1.0"}


def test_check_names(spark):
    res = {cv.SERVICE_NAME: "ynt", cv.SERVICE_VERSION: "1.0"}
    df = raw(spark, "traces", span("a", "b", "ynt.run", NOW, resource=res, attributes={"ynt.a": "1", "ynt.label.x": "1", "bad.attr": "2"},
                                   events=[{"name": "ynt.started"}, {"name": "other", "attributes": attrs({"http.method": "G"})}]),
             span("a", "c", "odd", NOW, resource=res), span("a", "c", "odd", NOW, resource={**res, cv.SERVICE_VERSION: "2.0"}))
    got = sorted((r.service, r.version, r.name, r["count"]) for r in g.check_names(df, registry(spark)).collect())
    assert got == [("ynt", "1.0", "bad.attr", 1), ("ynt", "1.0", "odd", 1), ("ynt", "1.0", "other", 1)]
    marked = sorted(json.dumps(r, sort_keys=True) for r in resource(g.mark_unknown(df, registry(spark))))
    assert sum(cv.REGISTRY_MARK in r for r in marked) == 1 and len(marked) == 3
    many = raw(spark, "traces", *[span("a", "b", f"n{i:04d}" + "x" * 200, NOW, resource=res) for i in range(1050)])
    out = g.check_names(many, registry(spark)).collect()
    assert len(out) == 1050 and not any(r.overflow for r in out) and {len(r.name) for r in out} == {205}
    out = g.check_names(many, registry(spark), cap=1000).collect()
    assert sum(not r.overflow for r in out) == 1000 and [r["count"] for r in out if r.overflow] == [50]


def test_vendor_names(spark):
    df = raw(spark, "traces", span("a", "b", "s", NOW, attributes={"known": "1", "new": "2", "not a name": "3"}))
    got = {r.name: r["count"] for r in g.unknown_vendor_names(df, spark.createDataFrame([("known",)], "name string"), "t").collect()}
    assert got == {"new": 1, cv.UNUSABLE: 1}
    assert g.unknown_vendor_names(df, spark.createDataFrame([("known",)], "name string"), "other").count() == 0


def test_budget(spark):
    rows = [("r1", f, o, 10) for f in ("a", "b", "c") for o in range(4)] + [("r2", "a", 0, 10)]
    df = spark.createDataFrame(rows, "run string, file string, offset int, bytes int")
    out = g.within_budget(df, spark.createDataFrame([("r1", 65)], "run string, budget bigint")).collect()
    assert sorted((r.file, r.offset) for r in out if r.run == "r1" and r.kept) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]
    assert all(r.over_budget == (r.run == "r1") for r in out)


def test_nesting(spark):
    from tracehold.sources.batches import nesting
    deep = lambda n: {"k": "v"} if n <= 1 else ({"k": deep(n - 1)} if n % 2 else [deep(n - 1)])
    df = lambda *values: spark.createDataFrame([(span("aa", "b", "s", NOW, attributes={"a": v}),) for v in values], "line string")
    for n in (1, 2, 3, 6):
        assert nesting(df(deep(n))) == max(2, n)
    assert nesting(df(deep(20), "x")) == cv.MAX_NESTING and nesting(df("x").limit(0)) == 2
    assert nesting(df({str(i): {"a": "b"} for i in range(9)}, 'text of {"arrayValue":{"kvlistValue":{"arrayValue":{{{')) == 2  # beside each other, and in a text
