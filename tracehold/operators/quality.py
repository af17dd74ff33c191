"""Telemetry-contract rules as batch checks over a capture.

A capture has one row a record, unstamped: ``scenario, run_kind, destination, kind, name, writer,
service, resource, attributes, trace_id, span_id, parent_span_id, status, line_key``. Each rule
gives ``scenario, rule, name, status, detail`` and, where it fails, rows of evidence. Records are
aggregated or joined on keys; no rule gathers a scenario in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.functions import otel
from tracehold.functions.text import id_like
from tracehold.operators.flatten import flatten_logs, flatten_points, flatten_spans
from tracehold.operators.governance import undeclared

PASS, FAIL, SKIPPED = "pass", "fail", "skipped"
CHECK = "scenario string, rule int, name string, status string, detail string"
REQUIRED = (cv.SERVICE_NAME, cv.SERVICE_VERSION, "service.instance.id")
STARTED = ".started"


@dataclass(frozen=True)
class Spec:
    """What a tool's conformance file says."""

    service: str
    units: tuple[str, ...] = ()
    marker_key: str = "conformance.marker"
    vendor_service: str = "stub-vendor"
    expected_outcome: str = ""
    canaries: dict[str, str] = field(default_factory=dict)


def capture(spans_raw: DataFrame | None, logs_raw: DataFrame | None, points_raw: DataFrame | None, keep: Sequence[str] = ()) -> DataFrame:
    """A capture from raw frames, without stamps or deduplication. ``keep`` names columns of the raw
    frames about the line: scenario, run_kind, destination, writer, line_key."""
    null = F.lit(None).cast("string")
    out = None

    def add(df: DataFrame, kind: Column, name: Column, trace: Column, span: Column, parent: Column, status: Column) -> None:
        nonlocal out
        part = df.select(kind.alias("kind"), name.alias("name"), "service", "resource", "attributes", trace.alias("trace_id"),
                         span.alias("span_id"), parent.alias("parent_span_id"), status.alias("status"), *keep)
        out = part if out is None else out.unionByName(part)
    if spans_raw is not None:
        f = flatten_spans(spans_raw, keep=keep)
        add(f, F.lit("span"), F.col("name"), F.col("trace_id"), F.col("span_id"), F.col("parent_span_id"), F.nullif("status", F.lit("unset")))
    if logs_raw is not None:
        f = flatten_logs(logs_raw, keep=keep)
        named = F.col("event").isNotNull()
        add(f, F.when(named, "event").otherwise("log"), F.when(named, F.col("event")).otherwise(F.col("severity")), F.col("trace_id"), F.col("span_id"), null, null)
    if points_raw is not None:
        f = flatten_points(points_raw, keep=keep)
        add(f, F.lit("metric"), F.col("name"), null, null, null, null)
    return out


def own(spec: Spec) -> Column:
    """The tool's records: its service, or none, which rule 2 reports."""
    return F.coalesce("service", F.lit("")).isin("", spec.service)


def _verdict(counts: DataFrame, rule: int, name: Column, status: Column, detail: Column) -> DataFrame:
    return counts.select("scenario", F.lit(rule).alias("rule"), name.alias("name"), status.alias("status"), detail.alias("detail"))


def routing(c: DataFrame, runs: DataFrame, spec: Spec) -> DataFrame:
    """Rule 1: records only where the settings send them. ``runs``: scenario, run_kind."""
    n = c.groupBy("scenario", "run_kind").agg(
        F.count_if(F.col("destination") == "spool").alias("spool"),
        F.count_if((F.col("destination") == "endpoint") & (F.coalesce("service", F.lit("")) != spec.vendor_service)).alias("endpoint"),
        F.count_if(F.col("destination") == "stray").alias("stray"))
    x = runs.join(n, ["scenario", "run_kind"], "left").fillna(0, ["spool", "endpoint", "stray"]).filter(
        F.col("run_kind").isin("spool", "endpoint", "neither"))
    kind = F.col("run_kind")
    bad = (F.when(kind == "spool", F.col("spool") == 0).when(kind == "endpoint", (F.col("endpoint") == 0) | (F.col("spool") > 0))
           .otherwise(F.col("stray") > 0))
    return _verdict(x, 1, F.concat(F.lit("where to write: "), kind), F.when(bad, FAIL).otherwise(PASS),
                    F.concat("spool", F.lit(" in the spool, "), "endpoint", F.lit(" at the endpoint, "), "stray", F.lit(" stray")))


def per_run(runs: DataFrame, records: DataFrame):
    """Records grouped by the runs that could have sent them; a run that sent none is a group too, with one
    row whose ``kind`` is NULL."""
    sent = runs.filter(F.col("run_kind").isin("spool", "endpoint"))
    of = sent.join(records.drop("destination"), ["scenario", "run_kind"], "left")
    return of.groupBy("scenario", F.col("run_kind").alias("destination"))


def every_scenario(x: DataFrame, runs: DataFrame | None, counts: Sequence[str]) -> DataFrame:
    """A rule's counts with a row of zeros for each scenario that gave none."""
    return x if runs is None else runs.select("scenario").distinct().join(x, "scenario", "left").fillna(0, list(counts))


def resource(c: DataFrame, runs: DataFrame, spec: Spec) -> DataFrame:
    """Rule 2: every own record names its service, version and instance and carries the run's marker.
    ``runs``: scenario, run_kind, marker."""
    tool = c.filter(own(spec) & (F.col("run_kind") == F.col("destination")))
    lacks = [F.coalesce(otel.attr(F.col("resource"), k), F.lit("")) == "" for k in REQUIRED]
    missing = sum((x.cast("int") for x in lacks), F.lit(0))
    x = per_run(runs, tool).agg(
        F.count("kind").alias("n"), F.sum(missing).alias("missing"), F.count_if(F.col("service") == spec.service).alias("named"),
        F.count_if(F.col("kind").isNotNull() & ~otel.attr(F.col("resource"), spec.marker_key).eqNullSafe(F.col("marker"))).alias("unmarked"))
    status = F.when(F.col("n") == 0, SKIPPED).when((F.col("missing") > 0) | (F.col("named") == 0) | (F.col("unmarked") > 0), FAIL).otherwise(PASS)
    detail = F.concat("n", F.lit(" records, "), "missing", F.lit(" attributes missing, "), "unmarked", F.lit(" without the marker"))
    return _verdict(x, 2, F.concat(F.lit("resource: "), F.col("destination")), status, detail)


def missing_resource(c: DataFrame, spec: Spec) -> DataFrame:
    """Rule 2's evidence: each required key an own kind of record lacks."""
    keys = F.array(*[F.when(F.coalesce(otel.attr(F.col("resource"), k), F.lit("")) == "", F.lit(k)) for k in REQUIRED])
    return (c.filter(own(spec)).select("scenario", "destination", "kind", "name", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))
            .distinct())


def joins_trace(c: DataFrame, runs: DataFrame, spec: Spec) -> DataFrame:
    """Rules 3 and 4: the tool's spans are in the trace it was given, one under the given span; and
    so are the spans of what it started. ``runs``: scenario, run_kind, expected_trace_id, expected_span_id."""
    s, mine = c.filter((F.col("kind") == "span") & (F.col("run_kind") == F.col("destination"))), own(spec) & F.col("kind").isNotNull()
    inside = F.col("trace_id").eqNullSafe(F.col("expected_trace_id"))
    x = per_run(runs, s).agg(
        F.count_if(mine).alias("n"), F.count_if(mine & ~inside).alias("foreign"),
        F.coalesce(F.bool_or(mine & inside & F.col("parent_span_id").eqNullSafe(F.col("expected_span_id"))), F.lit(False)).alias("joined"),
        F.count_if(~own(spec)).alias("others"), F.count_if(~own(spec) & ~inside).alias("outside"))
    three = _verdict(x, 3, F.concat(F.lit("joins the given trace: "), F.col("destination")),
                     F.when(F.col("n") == 0, F.when(F.col("destination") == "spool", FAIL).otherwise(SKIPPED))
                     .when((F.col("foreign") > 0) | ~F.col("joined"), FAIL).otherwise(PASS),
                     F.concat("foreign", F.lit(" of "), "n", F.lit(" spans in another trace")))
    four = _verdict(x, 4, F.concat(F.lit("passes the trace on: "), F.col("destination")),
                    F.when(F.col("others") == 0, SKIPPED).when(F.col("outside") > 0, FAIL).otherwise(PASS),
                    F.concat("outside", F.lit(" of "), "others", F.lit(" spans of started processes outside the trace")))
    return three.unionByName(four)


def starts(c: DataFrame, spec: Spec) -> DataFrame:
    """Own started events as the unit they announce."""
    e = c.filter((F.col("kind") == "event") & own(spec) & F.endswith("name", F.lit(STARTED)))
    return e.select("scenario", "run_kind", "trace_id", F.expr(f"substring(name, 1, length(name) - {len(STARTED)})").alias("unit"))


def units(c: DataFrame, runs: DataFrame, spec: Spec) -> DataFrame:
    """The tool's unit-of-work spans: those named, or else children of the given span, and any a
    started event announces."""
    s = c.filter((F.col("kind") == "span") & own(spec)).join(
        runs.select("scenario", "run_kind", "expected_trace_id", "expected_span_id"), ["scenario", "run_kind"])
    announced = starts(c, spec).select("scenario", "run_kind", F.col("unit").alias("name"), F.lit(True).alias("_a")).distinct()
    s = s.join(announced, ["scenario", "run_kind", "name"], "left")
    direct = (F.col("name").isin(*spec.units) if spec.units else
              F.col("parent_span_id").eqNullSafe(F.col("expected_span_id")) & F.col("trace_id").eqNullSafe(F.col("expected_trace_id")))
    return s.filter(F.coalesce("_a", F.lit(False)) | direct).drop("_a", "expected_trace_id", "expected_span_id")


def unmatched_starts(spans: DataFrame, started: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both directions of the pairing on ``keys``: a unit without its started event, and a start
    without its span, which in a finished run is a crash."""
    a = spans.join(started.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit("no start").alias("problem"))
    b = started.join(spans.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit("no span").alias("problem"))
    return a.unionByName(b)


def started_events(c: DataFrame, runs: DataFrame, spec: Spec) -> DataFrame:
    """Rule 5: each unit announces its start."""
    keys = ["scenario", "trace_id", "unit"]
    spool = c.filter((F.col("run_kind") == "spool") & (F.col("destination") == "spool"))
    u = units(spool, runs, spec).withColumnRenamed("name", "unit")
    st = starts(spool, spec)
    no_start = unmatched_starts(u, st, keys).filter("problem = 'no start'")
    any_span = spool.filter("kind = 'span'").withColumnRenamed("name", "unit")
    no_span = unmatched_starts(any_span, st, keys).filter("problem = 'no span'")
    bad = no_start.unionByName(no_span).groupBy("scenario").agg(F.count(F.lit(1)).alias("bad"))
    n = u.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    s = st.groupBy("scenario").agg(F.count(F.lit(1)).alias("s"))
    x = (runs.filter("run_kind = 'spool'").select("scenario").distinct().join(n, "scenario", "left").join(s, "scenario", "left")
         .join(bad, "scenario", "left").fillna(0, ["n", "s", "bad"]))
    status = F.when((F.col("n") == 0) & (F.col("s") == 0), SKIPPED).when(F.col("bad") > 0, FAIL).otherwise(PASS)
    return _verdict(x, 5, F.lit("started events"), status, F.concat("bad", F.lit(" of "), "n", F.lit(" units do not match")))


def survives_kill(c: DataFrame, runs: DataFrame, torn: DataFrame, spec: Spec) -> DataFrame:
    """Rule 5 after a kill: a start is on disk and no file ends in a partial line.
    ``runs``: scenario, run_kind, exited_early, timed_out. ``torn``: scenario, run_kind, path."""
    kill = runs.filter("run_kind = 'kill'")
    s = starts(c.filter("run_kind = 'kill'"), spec).groupBy("scenario").agg(F.count(F.lit(1)).alias("s"))
    t = torn.filter("run_kind = 'kill'").groupBy("scenario").agg(F.count(F.lit(1)).alias("t"))
    x = kill.join(s, "scenario", "left").join(t, "scenario", "left").fillna(0, ["s", "t"])
    status = F.when(F.col("t") > 0, FAIL).when(F.col("exited_early"), SKIPPED).when(F.col("s") == 0, FAIL).otherwise(PASS)
    return _verdict(x, 5, F.lit("started events survive a kill"), status, F.concat("s", F.lit(" started events, "), "t", F.lit(" torn files")))


def torn_files(files: DataFrame) -> DataFrame:
    """``path`` of files, as ``path, content``, whose last line is not complete."""
    return files.filter((F.octet_length("content") > 0) & (F.hex(F.substring("content", -1, 1)) != "0A")).select("path")


def declared_names(c: DataFrame, registry: DataFrame, spec: Spec, runs: DataFrame | None = None) -> DataFrame:
    """Rule 7: every name under the tool's prefix is in its registry. With ``runs``, a scenario that used no
    name is skipped."""
    mine = c.filter((F.col("service") == spec.service) & (F.col("run_kind") == F.col("destination")))
    names = F.concat(F.array(otel.row(kind=F.col("kind"), name=F.col("name"))),
                     F.transform(F.col("attributes"), lambda a: otel.row(kind=F.lit("attribute"), name=a["k"])),
                     F.transform(F.col("resource"), lambda a: otel.row(kind=F.lit("attribute"), name=a["k"])))
    used = (mine.select("scenario", F.explode(names).alias("n")).select("scenario", "n.kind", "n.name")
            .filter(F.startswith("name", F.lit(spec.service + ".")) & (F.col("kind") != "log"))
            .groupBy("scenario", "kind", "name").agg(F.count(F.lit(1)).alias("count")))
    reg = registry.filter(F.col("tool") == spec.service).withColumn("version", F.lit("-"))
    flat = used.select(F.lit(spec.service).alias("service"), F.lit("-").alias("version"), "kind", "name", "count").distinct()
    bad = undeclared(flat, reg).select("kind", "name").distinct()
    b = used.join(bad, ["kind", "name"], "left_semi").groupBy("scenario").agg(F.count(F.lit(1)).alias("bad"))
    x = used.groupBy("scenario").agg(F.sum("count").alias("n")).join(b, "scenario", "left").fillna(0, ["bad"])
    x = every_scenario(x, runs, ["n", "bad"])
    return _verdict(x, 7, F.lit("names: records"), F.when(F.col("n") == 0, SKIPPED).when(F.col("bad") > 0, FAIL).otherwise(PASS), F.concat("bad", F.lit(" undeclared names in "), "n"))


def registry_diff(printed: DataFrame, declared: DataFrame) -> DataFrame:
    """Rule 7: ``kind, name, side`` of names only one of two registries has."""
    a, b = printed.select("kind", "name").distinct(), declared.select("kind", "name").distinct()
    return (a.join(b, ["kind", "name"], "left_anti").withColumn("side", F.lit("printed"))
            .unionByName(b.join(a, ["kind", "name"], "left_anti").withColumn("side", F.lit("declared"))))


def metric_values(c: DataFrame, spec: Spec) -> DataFrame:
    """``scenario, metric, attr, value`` of own metric points."""
    return (c.filter((F.col("kind") == "metric") & own(spec)).select("scenario", F.col("name").alias("metric"), F.explode("attributes").alias("a"))
            .select("scenario", "metric", F.col("a.k").alias("attr"), F.col("a.v").alias("value")))


def cardinality_check(c: DataFrame, limits: DataFrame, spec: Spec, runs: DataFrame | None = None) -> DataFrame:
    """Rule 8: metric attributes carry no ids and stay inside the declared limits. With ``runs``, a scenario
    without points is skipped. ``limits``: metric, attr, limit."""
    values = metric_values(c, spec).distinct()
    per = values.groupBy("scenario", "metric", "attr").agg(F.count("value").alias("n"), F.bool_or(id_like(F.col("value")).isNotNull()).alias("id"))
    x = per.join(limits, ["metric", "attr"], "left").groupBy("scenario").agg(
        F.count_if(F.col("id")).alias("ids"), F.count_if((F.col("limit") > 0) & (F.col("n") > F.col("limit"))).alias("over"))
    points = c.filter((F.col("kind") == "metric") & own(spec)).groupBy("scenario").agg(F.count(F.lit(1)).alias("points"))
    x = points.join(x, "scenario", "left").fillna(0, ["ids", "over"])
    x = every_scenario(x, runs, ["points", "ids", "over"])
    return _verdict(x, 8, F.lit("cardinality"), F.when(F.col("points") == 0, SKIPPED).when((F.col("ids") > 0) | (F.col("over") > 0), FAIL).otherwise(PASS),
                    F.concat("ids", F.lit(" attributes hold ids, "), "over", F.lit(" are over their limit")))


def _interior_anchor(token: Column) -> Column:
    """The longest word strictly inside a token: between two characters that are not of words, so any
    text that holds the token holds this as a whole word. NULL when the token has none."""
    words = F.split(token, r"[^\p{L}\p{N}]+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.length(w) > 0)
    best = F.sort_array(F.transform(inner, lambda w: otel.row(n=-F.length(w), w=w)))
    return F.get(best, F.lit(0))["w"]


def scan_canaries(lines: DataFrame, tokens: DataFrame, line_key: str = "line_key", text: str = "line", chunk: int = 256) -> DataFrame:
    """``line_key, kind, snippet`` of every line that holds a planted string, for any number of lines
    and strings, over whole texts.

    A string with a word inside it is looked up by that word: an equi-join of the lines' distinct words
    with the strings' words, then an exact test of the few candidates. A string without one, such as a
    single random word, is tested directly, a bounded number of them in each pass.
    """
    t = tokens.filter(F.length("token") > 0).select("kind", "token").distinct().withColumn("_anchor", _interior_anchor(F.col("token")))
    anchored = t.filter("_anchor IS NOT NULL")
    words = lines.select(F.col(line_key), F.explode(F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+"))).alias("_anchor"))
    candidates = words.join(anchored, "_anchor").select(line_key, "kind", "token")
    found = lines.select(line_key, F.col(text).alias("_text")).join(candidates, line_key).filter(F.contains("_text", "token"))
    direct: list[tuple[str, str]] = []
    passes = []

    def flush() -> None:
        if direct:
            planted = F.array(*[otel.row(kind=F.lit(k), token=F.lit(v)) for k, v in direct])
            hits = F.filter(planted, lambda p: F.contains(F.col(text), p["token"]))
            passes.append(lines.select(line_key, F.col(text).alias("_text"), F.explode(hits).alias("p")).select(
                line_key, "_text", "p.kind", "p.token"))
            direct.clear()
    for r in t.filter("_anchor IS NULL").select("kind", "token").toLocalIterator():
        direct.append((r.kind, r.token))
        if len(direct) == chunk:
            flush()
    flush()
    out = found.select(line_key, "_text", "kind", "token")
    for p in passes:
        out = out.unionByName(p)
    at = F.position(F.col("token"), F.col("_text"))
    lo = F.greatest(at - F.lit(50), F.lit(1))
    around = F.substr("_text", lo, at - lo + F.length("token") + F.lit(30))
    return out.select(line_key, "kind", F.replace(around, F.col("token"), F.concat(F.lit("<canary:"), "kind", F.lit(">"))).alias("snippet"))


def canary_check(lines: DataFrame, hits: DataFrame) -> DataFrame:
    """Rule 10: no planted string in anything written. ``lines``: scenario, line_key."""
    h = hits.join(lines.select("scenario", "line_key"), "line_key").groupBy("scenario").agg(F.count(F.lit(1)).alias("bad"))
    x = lines.groupBy("scenario").agg(F.count(F.lit(1)).alias("n")).join(h, "scenario", "left").fillna(0, ["bad"])
    return _verdict(x, 10, F.lit("no content"), F.when(F.col("bad") > 0, FAIL).otherwise(PASS), F.concat("bad", F.lit(" hits in "), "n", F.lit(" lines")))


def status_conflicts(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Outcomes that end with more than one status."""
    return (rows.filter((F.coalesce("outcome", F.lit("")) != "") & (F.coalesce("status", F.lit("")) != ""))
            .groupBy(*keys, "outcome").agg(F.count_distinct("status").alias("statuses")).filter("statuses > 1"))


def outcomes(c: DataFrame, runs: DataFrame, spec: Spec) -> DataFrame:
    """Rule 11: each unit ends with an outcome and a status that agree, and as the scenario expects."""
    value = F.get(F.filter(F.col("attributes"), lambda a: F.endswith(a["k"], F.lit(".outcome")) & (F.coalesce(a["v"], F.lit("")) != "")), F.lit(0))["v"]
    u = units(c.filter((F.col("run_kind") == "spool") & (F.col("destination") == "spool")), runs, spec).select(
        "scenario", "status", value.alias("outcome"))
    bad = (F.col("outcome").isNull() | F.col("status").isNull()
           | (F.lit(bool(spec.expected_outcome)) & (F.col("outcome") != spec.expected_outcome)))
    n = u.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    clash = status_conflicts(u, ["scenario"]).groupBy("scenario").agg(F.count(F.lit(1)).alias("clash"))
    x = (runs.filter("run_kind = 'spool'").select("scenario").distinct().join(n, "scenario", "left").join(clash, "scenario", "left")
         .fillna(0, ["n", "bad", "clash"]))
    status = F.when(F.col("n") == 0, SKIPPED).when((F.col("bad") > 0) | (F.col("clash") > 0), FAIL).otherwise(PASS)
    return _verdict(x, 11, F.lit("outcomes"), status, F.concat("bad", F.lit(" problems, "), "clash", F.lit(" conflicts in "), "n", F.lit(" units")))


def never_blocks(runs: DataFrame, flush_ms: float, slack_ms: float) -> DataFrame:
    """Rule 12: an unwritable spool and a hung endpoint change neither exit code nor duration.
    ``runs``: scenario, run_kind, exit_code, duration_ms, timed_out."""
    base = runs.filter("run_kind = 'spool'").select("scenario", F.col("exit_code").alias("_exit"), F.col("duration_ms").alias("_ms"))
    x = runs.filter(F.col("run_kind").isin("unwritable", "hung")).join(base, "scenario", "left")
    bad = (F.col("timed_out") | ~F.col("exit_code").eqNullSafe(F.col("_exit")) | (F.col("duration_ms") > F.col("_ms") + flush_ms + slack_ms))
    status = F.when(F.col("_ms").isNull(), SKIPPED).when(bad, FAIL).otherwise(PASS)
    return _verdict(x, 12, F.concat(F.lit("never blocks: "), "run_kind"), status,
                    F.concat(F.lit("exit "), "exit_code", F.lit(" in "), "duration_ms", F.lit(" ms, normal "), F.coalesce(F.col("_ms").cast("string"), F.lit("-"))))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows one frame has more often than the other, with ``side`` and how many more (``times``).

    Signed counts in one aggregation, which combines before the shuffle; a row repeated a million times
    is one row of it.
    """
    cols = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*cols).withColumn("_n", F.lit(-1)))
    d = both.groupBy(*cols).agg(F.sum("_n").alias("_d")).filter("_d <> 0")
    return d.select(*cols, F.when(F.col("_d") > 0, "left").otherwise("right").alias("side"), F.abs("_d").alias("times"))


def store_unchanged(before: DataFrame, after: DataFrame, hits: DataFrame, scenario: str) -> DataFrame:
    """Rule 13: a store holds the same records before and after, and no planted string."""
    d = multiset_diff(before, after).agg(F.coalesce(F.sum(F.when(F.col("side") == "right", F.col("times"))), F.lit(0)).alias("added"),
                                         F.coalesce(F.sum(F.when(F.col("side") == "left", F.col("times"))), F.lit(0)).alias("removed"))
    x = d.withColumn("_one", F.lit(1)).join(hits.agg(F.count(F.lit(1)).alias("planted")).withColumn("_one", F.lit(1)), "_one").withColumn("scenario", F.lit(scenario))
    status = F.when((F.col("added") > 0) | (F.col("removed") > 0) | (F.col("planted") > 0), FAIL).otherwise(PASS)
    return _verdict(x, 13, F.lit("never into memory"), status, F.concat("added", F.lit(" added, "), "removed", F.lit(" removed, "), "planted", F.lit(" planted")))


def run_checks(c: DataFrame, runs: DataFrame, registry: DataFrame, limits: DataFrame, spec: Spec) -> DataFrame:
    """The rules that need only a capture, its runs and the tool's registry."""
    checks = [routing(c, runs, spec), resource(c, runs, spec), joins_trace(c, runs, spec), started_events(c, runs, spec),
              declared_names(c, registry, spec, runs), cardinality_check(c, limits, spec, runs), outcomes(c, runs, spec)]
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out


def summarise(checks: DataFrame) -> DataFrame:
    """``rule, status, failed``: a rule fails if any check of it failed, passes if one passed, else is skipped."""
    return checks.groupBy("rule").agg(
        F.when(F.bool_or(F.col("status") == FAIL), FAIL).when(F.bool_or(F.col("status") == PASS), PASS).otherwise(SKIPPED).alias("status"),
        F.count_if(F.col("status") == FAIL).alias("failed"))


def verdict(checks: DataFrame) -> DataFrame:
    """``ok``: whether no check failed."""
    return checks.agg((~F.coalesce(F.bool_or(F.col("status") == FAIL), F.lit(False))).alias("ok"))
