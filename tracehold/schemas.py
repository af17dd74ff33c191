"""Read schemas for OTLP JSON and the schemas of the flattened tables.

Schemas are always given, never inferred: a field that is not named is not parsed, and a file
cannot change the type of a column.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, I, B, TS = (T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(),
                     T.BooleanType(), T.TimestampType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# An attribute value. Arrays and maps stay JSON text, as do numbers that may come as strings.
VALUE_FIELDS = ("stringValue", "intValue", "boolValue", "doubleValue", "bytesValue",
                "arrayValue", "kvlistValue")
VALUE = struct(**{f: S for f in VALUE_FIELDS})
KEY_VALUE = T.ArrayType(struct(key=S, value=VALUE))
RESOURCE = struct(attributes=KEY_VALUE)
SCOPE = struct(name=S, version=S)

# Narrow read schemas: only what the tables use.
SPAN = struct(traceId=S, spanId=S, parentSpanId=S, name=S, kind=S, startTimeUnixNano=S,
              endTimeUnixNano=S, attributes=KEY_VALUE, status=struct(code=S, message=S))
LOG_RECORD = struct(timeUnixNano=S, observedTimeUnixNano=S, severityNumber=S, severityText=S,
                    eventName=S, body=S, attributes=KEY_VALUE, traceId=S, spanId=S)
POINT = struct(attributes=KEY_VALUE, startTimeUnixNano=S, timeUnixNano=S, asDouble=S, asInt=S)
HISTOGRAM_POINT = struct(attributes=KEY_VALUE, startTimeUnixNano=S, timeUnixNano=S, count=S, sum=S)
METRIC = struct(
    name=S, unit=S,
    gauge=struct(dataPoints=T.ArrayType(POINT)),
    sum=struct(dataPoints=T.ArrayType(POINT), aggregationTemporality=S, isMonotonic=B),
    histogram=struct(dataPoints=T.ArrayType(HISTOGRAM_POINT), aggregationTemporality=S),
    exponentialHistogram=struct(dataPoints=T.ArrayType(HISTOGRAM_POINT), aggregationTemporality=S))

RAW = {
    "traces": struct(resourceSpans=T.ArrayType(struct(
        resource=RESOURCE,
        scopeSpans=T.ArrayType(struct(scope=SCOPE, spans=T.ArrayType(SPAN)))))),
    "logs": struct(resourceLogs=T.ArrayType(struct(
        resource=RESOURCE,
        scopeLogs=T.ArrayType(struct(scope=SCOPE, logRecords=T.ArrayType(LOG_RECORD)))))),
    "metrics": struct(resourceMetrics=T.ArrayType(struct(
        resource=RESOURCE,
        scopeMetrics=T.ArrayType(struct(scope=SCOPE, metrics=T.ArrayType(METRIC)))))),
}


def value_type(depth: int) -> T.StructType:
    """An attribute value with ``depth`` levels of lists and maps parsed; deeper ones are text."""
    scalars = {f: S for f in VALUE_FIELDS[:5]}
    if depth == 0:
        return struct(**scalars, arrayValue=S, kvlistValue=S)
    inner = value_type(depth - 1)
    return struct(**scalars, arrayValue=struct(values=T.ArrayType(inner)),
                  kvlistValue=struct(values=T.ArrayType(struct(key=S, value=inner))))


def full(signal: str, depth: int = 2) -> T.StructType:
    """Every OTLP field of a signal, for jobs that write records on (scrub, stamp, name check)."""
    v = value_type(depth)
    kv = T.ArrayType(struct(key=S, value=v))
    res = struct(attributes=kv, droppedAttributesCount=S)
    scope = struct(name=S, version=S, attributes=kv, droppedAttributesCount=S)
    if signal == "traces":
        event = struct(timeUnixNano=S, name=S, attributes=kv, droppedAttributesCount=S)
        link = struct(traceId=S, spanId=S, traceState=S, attributes=kv, droppedAttributesCount=S, flags=S)
        span = struct(traceId=S, spanId=S, traceState=S, parentSpanId=S, flags=S, name=S, kind=S,
                      startTimeUnixNano=S, endTimeUnixNano=S, attributes=kv, droppedAttributesCount=S,
                      events=T.ArrayType(event), droppedEventsCount=S, links=T.ArrayType(link),
                      droppedLinksCount=S, status=struct(code=S, message=S))
        return struct(resourceSpans=T.ArrayType(struct(resource=res, scopeSpans=T.ArrayType(
            struct(scope=scope, spans=T.ArrayType(span), schemaUrl=S)), schemaUrl=S)))
    if signal == "logs":
        rec = struct(timeUnixNano=S, observedTimeUnixNano=S, severityNumber=S, severityText=S,
                     eventName=S, body=v, attributes=kv, droppedAttributesCount=S, flags=S,
                     traceId=S, spanId=S)
        return struct(resourceLogs=T.ArrayType(struct(resource=res, scopeLogs=T.ArrayType(
            struct(scope=scope, logRecords=T.ArrayType(rec), schemaUrl=S)), schemaUrl=S)))
    exemplars = T.ArrayType(struct(filteredAttributes=kv, timeUnixNano=S, asDouble=S, asInt=S,
                                   spanId=S, traceId=S))
    common = dict(attributes=kv, startTimeUnixNano=S, timeUnixNano=S)
    number = struct(**common, asDouble=S, asInt=S, exemplars=exemplars, flags=S)
    histo = struct(**common, count=S, sum=S, bucketCounts=T.ArrayType(S), explicitBounds=T.ArrayType(S),
                   exemplars=exemplars, flags=S, min=S, max=S)
    buckets = struct(offset=S, bucketCounts=T.ArrayType(S))
    expo = struct(**common, count=S, sum=S, scale=S, zeroCount=S, positive=buckets, negative=buckets,
                  flags=S, exemplars=exemplars, min=S, max=S, zeroThreshold=S)
    summary = struct(**common, count=S, sum=S,
                     quantileValues=T.ArrayType(struct(quantile=S, value=S)), flags=S)
    metric = struct(
        name=S, description=S, unit=S, gauge=struct(dataPoints=T.ArrayType(number)),
        sum=struct(dataPoints=T.ArrayType(number), aggregationTemporality=S, isMonotonic=B),
        histogram=struct(dataPoints=T.ArrayType(histo), aggregationTemporality=S),
        exponentialHistogram=struct(dataPoints=T.ArrayType(expo), aggregationTemporality=S),
        summary=struct(dataPoints=T.ArrayType(summary)), metadata=kv)
    return struct(resourceMetrics=T.ArrayType(struct(resource=res, scopeMetrics=T.ArrayType(
        struct(scope=scope, metrics=T.ArrayType(metric), schemaUrl=S)), schemaUrl=S)))


# Flattened tables.
ATTRS = T.ArrayType(struct(k=S, v=S))
_PROMOTED = dict(service=S, item_key=S, step_id=S, run_id=S, lane=S, harness=S, focus=S, repo=S,
                 outcome=S, actor=S, model=S, provenance=S, collector_id=S, collector_instance=S,
                 received_at=TS, labels=T.MapType(S, S))
_TAIL = dict(scope=S, resource=ATTRS, attributes=ATTRS, file=S)
SPANS = struct(record_id=S, time=TS, end_time=TS, duration_ms=D, trace_id=S, span_id=S,
               parent_span_id=S, name=S, kind=S, status=S, status_message=S, **_PROMOTED,
               cost_usd=D, **_TAIL)
LOGS = struct(record_id=S, time=TS, event=S, severity=S, severity_number=I, body=S, trace_id=S,
              span_id=S, **_PROMOTED, **_TAIL)
METRIC_POINTS = struct(record_id=S, time=TS, start_time=TS, name=S, unit=S, type=S, temporality=S,
                       monotonic=B, value=D, count=D, **_PROMOTED, **_TAIL)
TABLE = {"traces": SPANS, "logs": LOGS, "metrics": METRIC_POINTS}

RUN_ROLLUPS = struct(day=T.DateType(), lane=S, model=S, outcome=S, harness=S, repo=S, runs=L,
                     cost_usd=D, input_tokens=L, output_tokens=L, duration_ms=D)
METRIC_ROLLUPS = struct(day=T.DateType(), name=S, unit=S, type=S, temporality=S, service=S,
                        attributes=ATTRS, total=D, count=D, min=D, max=D, points=L)
ROLLUPS = {"runs": RUN_ROLLUPS, "metrics": METRIC_ROLLUPS}
ITEM_INDEX = struct(item_key=S, hour=TS, signal=S, step_id=S, trace_id=S, first_seen=TS,
                    last_seen=TS, manifest=I)
MANIFEST = struct(signal=S, hour=S, n=I, part=S, batch=S, records=L, compacted=TS)

RUN_MANIFEST = struct(run=S, lane=S, harness=S, focus=S, item=S, step=S, uid=L, run_quota_bytes=L)

_USE = T.ArrayType(struct(name=S, requirement_level=S, cardinality=I))
REGISTRY = struct(
    tool=S, version=S, semantic_conventions=struct(name=S, version=S, schema_url=S),
    attributes=T.ArrayType(struct(id=S, type=S, brief=S, stability=S,
                                  annotations=T.MapType(S, S))),
    standard_attributes=T.ArrayType(S),
    spans=T.ArrayType(struct(name=S, kind=S, brief=S, attributes=_USE)),
    events=T.ArrayType(struct(name=S, brief=S, attributes=_USE)),
    metrics=T.ArrayType(struct(name=S, instrument=S, unit=S, brief=S, attributes=_USE)))
