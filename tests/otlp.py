"""Export requests and batches for the scenario tests."""

import datetime as dt
import gzip
import json
import os

from tracehold import conventions as cv

NOW = dt.datetime(2026, 10, 5, 21, 30)
_seq = [0]


def ns(t):
    return str(int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000) * 1000)


def value(v):
    if isinstance(v, bool):
        return {"boolValue": v}
    if isinstance(v, int):
        return {"intValue": str(v)}
    if isinstance(v, float):
        return {"doubleValue": v}
    if isinstance(v, list):
        return {"arrayValue": {"values": [value(x) for x in v]}}
    if isinstance(v, dict):
        return {"kvlistValue": {"values": attrs(v)}}
    return {"stringValue": v}


def attrs(d):
    return [{"key": k, "value": value(v)} for k, v in d.items()]


def span(trace, sid, name, at, ms=90_000.0, resource=None, attributes=None, parent="", status=None, **more):
    s = {"traceId": trace, "spanId": sid, "parentSpanId": parent, "name": name, "kind": 1, "startTimeUnixNano": ns(at),
         "endTimeUnixNano": ns(at + dt.timedelta(milliseconds=ms)), "attributes": attrs(attributes or {}), **more}
    if status:
        s["status"] = {"code": status}
    return json.dumps({"resourceSpans": [{"resource": {"attributes": attrs(resource or {})}, "scopeSpans": [{"scope": {"name": "t"}, "spans": [s]}]}]})


def run(trace, sid, lane, outcome, model, cost, at, resource=None, attributes=None):
    res = {cv.SERVICE_NAME: "runner", **({cv.LANE: lane} if lane else {}), **(resource or {})}
    return span(trace.rjust(32, "0"), sid.rjust(16, "0"), cv.RUN_SPAN, at, resource=res, attributes={
        cv.RUN_OUTCOME: outcome, cv.RESPONSE_MODEL: model, cv.RUN_COST: cost, cv.INPUT_TOKENS: 1000, cv.OUTPUT_TOKENS: 200, **(attributes or {})})


def event(name, at, resource=None, attributes=None, trace="", sid="", severity="INFO", body="b"):
    r = {"timeUnixNano": ns(at), "severityNumber": 9, "severityText": severity, "body": {"stringValue": body},
         "attributes": attrs(attributes or {}), "traceId": trace, "spanId": sid}
    if name:
        r["eventName"] = name
    return json.dumps({"resourceLogs": [{"resource": {"attributes": attrs(resource or {})}, "scopeLogs": [{"scope": {"name": "t"}, "logRecords": [r]}]}]})


def metric(name, temporality, v, at, kind="sum", resource=None, attributes=None, start=dt.datetime(2026, 1, 1)):
    p = {"startTimeUnixNano": ns(start), "timeUnixNano": ns(at), "attributes": attrs(attributes or {"gen_ai.response.model": "m"})}
    shape = {"aggregationTemporality": temporality}
    if kind in ("gauge", "sum"):
        p["asDouble"] = v
    else:
        p.update(count="3", sum=v)
    if kind == "gauge":
        shape = {}
    if kind == "sum":
        shape["isMonotonic"] = True
    return json.dumps({"resourceMetrics": [{"resource": {"attributes": attrs(resource or {cv.SERVICE_NAME: "s"})}, "scopeMetrics": [
        {"scope": {"name": "t"}, "metrics": [{"name": name, "unit": "1", kind: {**shape, "dataPoints": [p]}}]}]}]})


def ship(root, signal, received, *lines, collector="c1", raw=None):
    _seq[0] += 1
    folder = os.path.join(root, signal, received.strftime("%Y/%m/%d/%H"), collector)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{_seq[0]:026d}_local.f-0-{_seq[0]}.jsonl.gz")
    with open(path, "wb") as f:
        f.write(raw if raw is not None else gzip.compress(("\n".join(lines) + "\n").encode()))
    return path
