"""OTLP batches to flat tables, one narrow pass per signal.

Each view explodes resource, then scope, then record. Attribute lists are decoded once per resource
and once per record, before anything is copied to the level below. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.functions import otel
from tracehold.operators.dedupe import one_per_record


def _identity_resource(resource: Column, identity: str, c: cv.Conventions) -> Column:
    """What of the resource belongs to a record's identity: the stamped transport attributes differ
    between two deliveries of one record, so the logical identity leaves them out."""
    if identity == "raw":
        return resource
    if identity != "logical":
        raise ValueError(f"identity {identity!r}")
    return F.filter(resource, lambda a: ~F.coalesce(a["key"].isin(*c.transport), F.lit(False)))


def _file(raw: DataFrame) -> Column:
    return F.col("file") if "file" in raw.columns else F.lit(None).cast("string").alias("file")


def _extra(raw: DataFrame, keep: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keep]


def _promoted(c: cv.Conventions) -> list[Column]:
    return [e.alias(n) for n, e in otel.promote(F.col("resource"), F.col("attributes"), c).items()]


def flatten_spans(raw: DataFrame, erased: Sequence[str] = (), c: cv.Conventions = cv.DEFAULT,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Every span of every batch, copies included. ``keep`` carries columns of ``raw`` along."""
    extra = _extra(raw, keep)
    r = raw.select(_file(raw), *extra, F.explode("resourceSpans").alias("r"))
    s = r.select("file", *extra, otel.mask_attrs(otel.otel_attrs(F.col("r.resource.attributes")), erased).alias("resource"),
                 F.explode("r.scopeSpans").alias("s"))
    x = s.select("file", *extra, "resource", F.col("s.scope.name").alias("scope"), F.explode("s.spans").alias("sp"))
    y = x.select("file", *extra, "resource", "scope", F.col("sp").dropFields("attributes").alias("sp"),
                 otel.mask_attrs(otel.otel_attrs(F.col("sp.attributes")), erased).alias("attributes"))
    tid, sid = F.lower("sp.traceId"), F.lower("sp.spanId")
    return y.select(
        F.concat(tid, F.lit("/"), sid).alias("record_id"),
        otel.otel_time(F.col("sp.startTimeUnixNano")).alias("time"),
        otel.otel_time(F.col("sp.endTimeUnixNano")).alias("end_time"),
        otel.span_duration_ms(F.col("sp.startTimeUnixNano"), F.col("sp.endTimeUnixNano")).alias("duration_ms"),
        tid.alias("trace_id"), sid.alias("span_id"),
        otel.lower_id(F.col("sp.parentSpanId")).alias("parent_span_id"),
        F.col("sp.name").alias("name"), otel.otel_kind(F.col("sp.kind")).alias("kind"),
        otel.otel_status(F.col("sp.status.code")).alias("status"),
        F.col("sp.status.message").alias("status_message"),
        *_promoted(c), otel.attr(F.col("attributes"), c.run_cost).try_cast("double").alias("cost_usd"),
        "scope", "resource", otel.own_projection(F.col("attributes")).alias("attributes"), "file", *extra)


def flatten_logs(raw: DataFrame, erased: Sequence[str] = (), identity: str = "logical",
                 c: cv.Conventions = cv.DEFAULT, keep: Sequence[str] = ()) -> DataFrame:
    """Every log record of every batch, copies included."""
    extra = _extra(raw, keep)
    r = raw.select(_file(raw), *extra, F.explode("resourceLogs").alias("r"))
    s = r.select("file", *extra, otel.mask_attrs(otel.otel_attrs(F.col("r.resource.attributes")), erased).alias("resource"),
                 F.to_json(F.struct(_identity_resource(F.col("r.resource.attributes"), identity, c).alias("r"))).alias("rid"),
                 F.explode("r.scopeLogs").alias("s"))
    x = s.select("file", *extra, "resource", "rid", F.col("s.scope.name").alias("scope"), F.explode("s.logRecords").alias("lr"))
    y = x.select("file", *extra, "resource", "scope", F.col("lr").dropFields("attributes").alias("lr"),
                 F.md5(F.concat("rid", F.to_json("lr"))).alias("record_id"),
                 otel.mask_attrs(otel.otel_attrs(F.col("lr.attributes")), erased).alias("attributes"))
    return y.select(
        "record_id",
        F.coalesce(otel.otel_time(F.col("lr.timeUnixNano")), otel.otel_time(F.col("lr.observedTimeUnixNano"))).alias("time"),
        otel.event_name(F.col("lr.eventName"), F.col("attributes")).alias("event"),
        F.col("lr.severityText").alias("severity"),
        otel.otel_text(F.col("lr.severityNumber")).try_cast("int").alias("severity_number"),
        otel.log_body(F.col("lr.body")).alias("body"),
        otel.lower_id(F.col("lr.traceId")).alias("trace_id"), otel.lower_id(F.col("lr.spanId")).alias("span_id"),
        *_promoted(c), "scope", "resource", otel.own_projection(F.col("attributes")).alias("attributes"), "file", *extra)


_POINT = ("array<struct<type:string,temporality:string,monotonic:boolean,start:string,at:string,value:double,"
          "count:double,attributes:array<struct<k:string,v:string>>,pid:string>>")


def _points(m: Column, field: str, type_name: str, histogram: bool) -> Column:
    """One metric shape's data points in the shape shared by all four."""
    shape = m[field]
    gauge = field == "gauge"
    temporality = F.lit(None).cast("string") if gauge else otel.otel_temporality(shape["aggregationTemporality"])
    monotonic = shape["isMonotonic"] if field == "sum" else F.lit(None).cast("boolean")

    def one(p: Column) -> Column:
        value = (otel.otel_num(p["sum"]) if histogram
                 else F.coalesce(otel.otel_num(p["asDouble"]), otel.otel_num(p["asInt"])))
        return F.struct(F.lit(type_name).alias("type"), temporality.alias("temporality"),
                        monotonic.alias("monotonic"), p["startTimeUnixNano"].alias("start"),
                        p["timeUnixNano"].alias("at"), value.alias("value"),
                        (otel.otel_num(p["count"]) if histogram else F.lit(None).cast("double")).alias("count"),
                        otel.otel_attrs(p["attributes"]).alias("attributes"), F.to_json(p).alias("pid"))
    return F.coalesce(F.transform(shape["dataPoints"], one).cast(_POINT), F.array().cast(_POINT))


def flatten_points(raw: DataFrame, erased: Sequence[str] = (), identity: str = "logical",
                   c: cv.Conventions = cv.DEFAULT, keep: Sequence[str] = ()) -> DataFrame:
    """Every gauge, sum, histogram and exponential histogram point, copies included. The four shapes
    are one array per metric, so the batch is scanned once rather than once per shape."""
    extra = _extra(raw, keep)
    r = raw.select(_file(raw), *extra, F.explode("resourceMetrics").alias("r"))
    s = r.select("file", *extra, otel.mask_attrs(otel.otel_attrs(F.col("r.resource.attributes")), erased).alias("resource"),
                 F.to_json(F.struct(_identity_resource(F.col("r.resource.attributes"), identity, c).alias("r"))).alias("rid"),
                 F.explode("r.scopeMetrics").alias("s"))
    x = s.select("file", *extra, "resource", "rid", F.col("s.scope.name").alias("scope"), F.explode("s.metrics").alias("m"))
    m = F.col("m")
    p = x.select("file", *extra, "resource", "rid", "scope", F.col("m.name").alias("name"), F.col("m.unit").alias("unit"),
                 F.explode(F.concat(_points(m, "gauge", "gauge", False), _points(m, "sum", "sum", False),
                                    _points(m, "histogram", "histogram", True),
                                    _points(m, "exponentialHistogram", "exponential_histogram", True))).alias("p"))
    y = p.select("file", *extra, "resource", "scope", "name", "unit", "p.type", "p.temporality", "p.monotonic",
                 "p.start", "p.at", "p.value", "p.count", otel.mask_attrs(F.col("p.attributes"), erased).alias("attributes"),
                 F.md5(F.concat("rid", F.coalesce("name", F.lit("")), "p.pid")).alias("record_id"))
    return y.select("record_id", otel.otel_time(F.col("at")).alias("time"), otel.otel_time(F.col("start")).alias("start_time"),
                    "name", "unit", "type", "temporality", "monotonic", "value", "count",
                    *_promoted(c), "scope", "resource", otel.own_projection(F.col("attributes")).alias("attributes"), "file", *extra)


FLATTEN = {"traces": flatten_spans, "logs": flatten_logs, "metrics": flatten_points}


def flatten(signal: str, raw: DataFrame, erased: Sequence[str] = (), identity: str = "logical",
            c: cv.Conventions = cv.DEFAULT) -> DataFrame:
    if signal == "traces":
        return flatten_spans(raw, erased, c)
    return FLATTEN[signal](raw, erased, identity, c)


def spans(raw: DataFrame, **options) -> DataFrame:
    return one_per_record(flatten_spans(raw, **options))


def logs(raw: DataFrame, **options) -> DataFrame:
    return one_per_record(flatten_logs(raw, **options))


def metric_points(raw: DataFrame, **options) -> DataFrame:
    return one_per_record(flatten_points(raw, **options))


def records(spans_raw: DataFrame | None, logs_raw: DataFrame | None, points_raw: DataFrame | None,
            keep: Sequence[str] = (), writer: str = "file") -> DataFrame:
    """Spans, events, logs and points as one row type, for following what arrives. Copies are kept:
    a follower shows each line once. The inputs are raw frames; any may be None.

    Where the frames carry ``class, _lane, _item`` (``governance.with_manifest``), a run's lane and item
    are what its manifest says.
    """
    null = lambda t: F.lit(None).cast(t)
    trusted = "_lane" in keep

    def trust(column: str, from_manifest: str) -> Column:
        return F.when(F.col("class") == "run", F.col(from_manifest)).otherwise(F.col(column)) if trusted else F.col(column)

    def one(f: DataFrame, kind: Column, name: Column, **own: Column) -> DataFrame:
        cols = {"status": null("string"), "duration_ms": null("double"), "value": null("double"), "body": null("string"),
                "trace_id": null("string"), "span_id": null("string"), **own}
        return f.select("time", kind.alias("kind"), "service", name.alias("name"), trust("lane", "_lane").alias("lane"),
                        trust("item_key", "_item").alias("item"), "outcome", *[c.alias(n) for n, c in cols.items()],
                        F.col(writer).alias("writer"))
    frames = []
    if spans_raw is not None:
        frames.append(one(flatten_spans(spans_raw, keep=keep), F.lit("span"), F.col("name"), trace_id=F.col("trace_id"), span_id=F.col("span_id"),
                          status=F.nullif("status", F.lit("unset")), duration_ms=F.col("duration_ms")))
    if logs_raw is not None:
        named = F.col("event").isNotNull()
        frames.append(one(flatten_logs(logs_raw, keep=keep), F.when(named, "event").otherwise("log"),
                          F.when(named, F.col("event")).otherwise(F.col("severity")), body=F.col("body"), trace_id=F.col("trace_id"),
                          span_id=F.when(F.col("trace_id").isNotNull(), F.col("span_id"))))
    if points_raw is not None:
        frames.append(one(flatten_points(points_raw, keep=keep), F.lit("metric"), F.col("name"), value=F.coalesce("value", F.lit(0.0))))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def keep_records(rows: DataFrame, service: str | None = None, item: str | None = None) -> DataFrame:
    """The records of one service and one item; an empty wish keeps all."""
    if service:
        rows = rows.filter(F.col("service") == service)
    if item:
        rows = rows.filter(F.col("item") == item)
    return rows
