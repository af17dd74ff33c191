"""Provenance, privacy and name governance over raw OTLP frames and flat tables.

Raw frames are those ``sources.batches.parse_lines(..., whole=True)`` gives: one column with the
signal's resource array in its full schema, next to columns about the line (writer class, run).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracehold import conventions as cv
from tracehold.functions.otel import row
from tracehold.functions.text import account_hash, bare, clean_home, is_email, under_home, usable_name
from tracehold.operators.prefix import running_total
from tracehold.schemas import full

_FACTORY = (cv.LANE, cv.LANE_HARNESS, cv.LANE_FOCUS, cv.ITEM_KEY, cv.STEP_ID, cv.RUN_ID)


# --- paths of a signal's schema ------------------------------------------------------------------
def _fields(t: T.StructType, value: Column, **new: Column) -> Column:
    """A struct rebuilt field by field: a NULL one becomes one of NULLs, so a new field is never lost."""
    return row(**{f.name: new.get(f.name, value[f.name]) for f in t.fields})


def _walk(t: T.DataType, value: Column, kv: T.DataType, on_attrs: Callable[[Column], Column]) -> Column:
    """Apply ``on_attrs`` to every attribute list of a nested value, at any level of its schema."""
    if t == kv:
        return on_attrs(value)
    if isinstance(t, T.ArrayType) and _holds(t.elementType, kv):
        return F.transform(value, lambda x: _walk(t.elementType, x, kv, on_attrs))
    if isinstance(t, T.StructType) and _holds(t, kv):
        out = row(**{f.name: _walk(f.dataType, value[f.name], kv, on_attrs) for f in t.fields})
        return F.when(value.isNotNull(), out)
    return value


def _holds(t: T.DataType, kv: T.DataType) -> bool:
    if t == kv:
        return True
    if isinstance(t, T.ArrayType):
        return _holds(t.elementType, kv)
    if isinstance(t, T.StructType) and "stringValue" not in t.fieldNames():
        return any(_holds(f.dataType, kv) for f in t.fields)
    return False


def _gather(t: T.DataType, value: Column, kv: T.DataType, take: Callable[[Column], Column], empty: Column) -> list[Column]:
    """``take`` of every attribute list of a nested value, as arrays to concatenate."""
    if t == kv:
        return [F.coalesce(take(value), empty)]
    if isinstance(t, T.ArrayType) and _holds(t.elementType, kv):
        def one(x: Column) -> Column:
            parts = _gather(t.elementType, x, kv, take, empty)
            return F.concat(*parts) if len(parts) > 1 else parts[0]
        return [F.coalesce(F.flatten(F.transform(value, one)), empty)]
    if isinstance(t, T.StructType) and _holds(t, kv):
        return [p for f in t.fields for p in _gather(f.dataType, value[f.name], kv, take, empty)]
    return []


def _signal_of(raw: DataFrame) -> tuple[str, str]:
    for s, c in cv.RESOURCE_COLUMN.items():
        if c in raw.columns:
            return s, c
    raise ValueError("no resource column")


def _depth(raw: DataFrame) -> int:
    """How many levels of lists and maps a raw frame was parsed to."""
    _, column = _signal_of(raw)
    value, depth = raw.schema[column].dataType.elementType["resource"].dataType["attributes"].dataType.elementType["value"].dataType, 0
    while isinstance(value["arrayValue"].dataType, T.StructType):
        value, depth = value["arrayValue"].dataType["values"].dataType.elementType, depth + 1
    return depth


def _kv(depth: int) -> T.ArrayType:
    return full("logs", depth)["resourceLogs"].dataType.elementType["resource"].dataType["attributes"].dataType


def _string(v: Column, like: T.StructType) -> Column:
    """A string attribute value of a schema's value type."""
    return row(**{f.name: v if f.name == "stringValue" else F.lit(None).cast(f.dataType) for f in like.fields})


def _pair(key: str, v: Column, kv: T.ArrayType) -> Column:
    return row(key=F.lit(key), value=_string(v, kv.elementType["value"].dataType))


# --- stamping -------------------------------------------------------------------------------------
def with_manifest(lines: DataFrame, manifests: DataFrame | None) -> DataFrame:
    """Lines of ``class, name`` with the trusted mapping of their run and a warning where it is missing.

    An outer equi-join on the run: small manifests are broadcast by Spark's own size check, large ones
    shuffle, and the adaptive skew join splits a run with most of the lines. Lines that no run wrote share
    a name and would meet in one task; a caller that has them apart gives no manifests, and nothing is joined.
    """
    if manifests is None:
        return lines.withColumns({n: F.lit(None).cast(t) for n, t in (
            ("valid", "boolean"), ("budget", "bigint"), ("warning", "string"), *[(f"_{c}", "string") for c in ("run", "lane", "harness", "focus", "item", "step")])})
    m = manifests.select(F.col("run").alias("_run"), "valid", *[F.col(c).alias(f"_{c}") for c in (
        "lane", "harness", "focus", "item", "step")], "budget")
    is_run = F.col("class") == "run"
    out = lines.join(m, is_run & (F.col("name") == F.col("_run")), "left")
    over = F.coalesce(F.col("over_budget"), F.lit(False)) if "over_budget" in lines.columns else F.lit(False)
    warning = (F.when(~is_run, None).when(over, cv.OVER_BUDGET).when(F.col("valid").isNull(), cv.NO_MANIFEST)
               .when(~F.col("valid"), cv.BAD_MANIFEST))
    return out.withColumn("warning", warning).withColumns({
        f"_{c}": F.when(F.col("valid"), F.col(f"_{c}")) for c in ("lane", "harness", "focus", "item", "step")}).withColumn(
        "_run", F.when(F.col("valid"), F.col("_run")))


def stamp(raw: DataFrame, manifests: DataFrame | None, collector_id: str, instance: str | None = None, received: Column | None = None) -> DataFrame:
    """Each resource with the sender's own stamps removed and the reader's put in their place.

    ``raw`` has ``class`` and ``name`` of its writer. A run's factory attributes come only from its
    manifest; without one the record is kept and warned about. ``manifests`` may be None where no run
    wrote any of the lines.
    """
    signal, column = _signal_of(raw)
    depth = _depth(raw)
    kv = _kv(depth)
    received = received if received is not None else F.current_timestamp()
    text = F.date_format(received, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    df = with_manifest(raw, manifests)
    run = F.col("class") == "run"
    own = [(cv.PROVENANCE, F.col("class")), (cv.COLLECTOR_ID, F.lit(collector_id)), (cv.RECEIVED_AT, text),
           (cv.COLLECTOR_INSTANCE, F.lit(instance or None).cast("string")), (cv.PROVENANCE_WARNING, F.col("warning")),
           (cv.RUN_ID, F.col("_run")), (cv.LANE, F.col("_lane")), (cv.LANE_HARNESS, F.col("_harness")),
           (cv.LANE_FOCUS, F.col("_focus")), (cv.ITEM_KEY, F.col("_item")), (cv.STEP_ID, F.col("_step"))]
    added = F.filter(F.array(*[_pair(k, v, kv) for k, v in own]), lambda a: F.coalesce(a["value"]["stringValue"], F.lit("")) != "")
    df = df.withColumn("_stamps", added).withColumn("_is_run", run)
    res_t = full(signal, depth)[column].dataType.elementType
    inner = res_t["resource"].dataType

    def one(r: Column) -> Column:
        kept = F.filter(F.coalesce(r["resource"]["attributes"], F.array().cast(kv)), lambda a: ~F.coalesce(
            F.startswith(a["key"], F.lit(cv.STAMP_PREFIX)) | (F.col("_is_run") & a["key"].isin(*_FACTORY)), F.lit(False)))
        return _fields(res_t, r, resource=_fields(inner, r["resource"], attributes=F.concat(kept, F.col("_stamps"))))
    out = df.withColumn(column, F.transform(F.col(column), one))
    return out.select(*raw.columns, "warning")


# --- scrubbing ------------------------------------------------------------------------------------
class Scrub:
    """Drops what identifies a person or a machine from every attribute list, at every level.

    Values nested deeper than the schema parses are dropped: nothing unread is let through.
    """

    def __init__(self, home: str | None = None, key: bytes | None = None, depth: int = 2):
        self.home, self.key, self.depth = clean_home(home), key, depth

    def _bad_text(self, s: Column) -> Column:
        return F.coalesce(is_email(s) | under_home(s, self.home), F.lit(False))

    def drops(self, v: Column, depth: int) -> Column:
        """True when a value must go whole."""
        if depth == 0:
            return self._bad_text(v["stringValue"]) | v["arrayValue"].isNotNull() | v["kvlistValue"].isNotNull()
        return self._bad_text(v["stringValue"]) | F.coalesce(
            F.exists(v["arrayValue"]["values"], lambda e: self.drops(e, depth - 1)), F.lit(False))

    def clean(self, v: Column, depth: int) -> Column:
        """A value with the maps inside it scrubbed."""
        if depth == 0:
            return v
        t = full("logs", depth)["resourceLogs"].dataType.elementType["resource"].dataType["attributes"].dataType.elementType["value"].dataType
        arrays = F.when(v["arrayValue"].isNotNull(), row(values=F.transform(v["arrayValue"]["values"], lambda e: self.clean(e, depth - 1))))
        maps = F.when(v["kvlistValue"].isNotNull(), row(values=self.attrs(v["kvlistValue"]["values"], depth - 1)))
        return F.when(v.isNotNull(), _fields(t, v, arrayValue=arrays, kvlistValue=maps))

    def _text(self, v: Column) -> Column:
        return F.coalesce(*[v[f] for f in ("stringValue", "intValue", "boolValue", "doubleValue", "bytesValue")], F.lit(""))

    def gone(self, a: Column, depth: int) -> Column:
        """True when an attribute is dropped."""
        named = F.coalesce(a["key"].isin(*cv.STRIPPED), F.lit(False))
        account = F.coalesce(a["key"].isin(*cv.ACCOUNT_IDS), F.lit(False))
        unhashed = account & (F.lit(True) if self.key is None else self._text(a["value"]) == "")
        return named | self.drops(a["value"], depth) | unhashed

    def attrs(self, l: Column, depth: int) -> Column:
        """An attribute list without what must go, account ids replaced by their keyed hash."""
        kept = F.filter(l, lambda a: ~self.gone(a, depth))

        def one(a: Column) -> Column:
            value = self.clean(a["value"], depth)
            if self.key is not None:
                t = full("logs", depth)["resourceLogs"].dataType.elementType["resource"].dataType["attributes"].dataType.elementType["value"].dataType
                value = F.when(a["key"].isin(*cv.ACCOUNT_IDS), _string(account_hash(self._text(a["value"]), self.key), t)).otherwise(value)
            return row(key=a["key"], value=value)
        return F.transform(kept, one)


def scrub(raw: DataFrame, home: str | None = None, hash_key: bytes | None = None, override: dict[str, str] | None = None) -> DataFrame:
    """Every attribute list of a raw frame scrubbed, then ``override`` set on every resource."""
    signal, column = _signal_of(raw)
    depth = _depth(raw)
    kv, s = _kv(depth), Scrub(home, hash_key, depth)
    for k, v in (override or {}).items():
        bad_home = s.home is not None and (v == s.home or v.startswith(s.home + "/"))
        if not k or not v or k in cv.STRIPPED or bad_home or re.fullmatch(bare(cv.EMAIL), v):
            raise ValueError(f"resource attribute {k!r} cannot be set: it is what the scrub removes, or empty")
    t = full(signal, depth)[column].dataType
    out = raw.withColumn(column, _walk(t, F.col(column), kv, lambda l: s.attrs(l, depth)))
    if not override:
        return out
    res_t = t.elementType
    fresh = F.array(*[_pair(k, F.lit(v), kv) for k, v in override.items()])

    def one(r: Column) -> Column:
        kept = F.filter(F.coalesce(r["resource"]["attributes"], F.array().cast(kv)), lambda a: ~a["key"].isin(*override))
        return _fields(res_t, r, resource=_fields(res_t["resource"].dataType, r["resource"], attributes=F.concat(kept, fresh)))
    return out.withColumn(column, F.transform(F.col(column), one))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def _inside(v: Column, depth: int) -> Column:
    """How many attributes the maps inside a value hold."""
    if depth == 0:
        return F.lit(0)
    return (F.coalesce(_entries(v["kvlistValue"]["values"], depth - 1), F.lit(0))
            + F.coalesce(_total(F.transform(v["arrayValue"]["values"], lambda e: _inside(e, depth - 1))), F.lit(0)))


def _entries(l: Column, depth: int) -> Column:
    """How many attributes a list holds, those inside its values included."""
    return _total(F.transform(l, lambda a: F.lit(1) + _inside(a["value"], depth)))


def attribute_entries(raw: DataFrame) -> Column:
    """Attributes in all lists of each line."""
    signal, column = _signal_of(raw)
    depth = _depth(raw)
    kv = _kv(depth)
    counts = _gather(full(signal, depth)[column].dataType, F.col(column), kv, lambda l: F.array(F.coalesce(_entries(l, depth), F.lit(0))),
                     F.array().cast("array<int>"))
    return F.aggregate(F.concat(*counts) if len(counts) > 1 else counts[0], F.lit(0), lambda acc, x: acc + x)


def scrub_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``stripped``: how many attributes a scrub removed in all."""
    n = lambda df, sign: df.agg((F.sum(attribute_entries(df)) * sign).alias("n"))
    return n(before, 1).union(n(after, -1)).agg(F.sum("n").alias("stripped"))


# --- names ----------------------------------------------------------------------------------------
def used_names(raw: DataFrame) -> DataFrame:
    """``service, version, scope, kind, name`` of every span, event, metric and record attribute name.

    Resource and scope attributes are not names of the tool's own records, so they are not listed.
    """
    signal, column = _signal_of(raw)
    r = raw.select(F.explode(column).alias("r"))
    attr = lambda k: F.get(F.transform(F.filter(F.col("r.resource.attributes"), lambda a: a["key"] == k), lambda a: a["value"]["stringValue"]), F.lit(0))
    base = r.select(F.coalesce(attr(cv.SERVICE_NAME), F.lit("")).alias("service"), F.coalesce(attr(cv.SERVICE_VERSION), F.lit("")).alias("version"), "r")
    shape = "array<struct<kind:string,name:string>>"
    none = F.array().cast(shape)

    def keys(l: Column) -> Column:
        return F.coalesce(F.transform(l, lambda a: row(kind=F.lit("attribute"), name=a["key"])).cast(shape), none)

    def own(kind: str, name: Column) -> Column:
        return F.array(row(kind=F.lit(kind), name=name)).cast(shape)
    if signal == "traces":
        s = base.select("service", "version", F.explode("r.scopeSpans").alias("s"))
        x = s.select("service", "version", F.col("s.scope.name").alias("scope"), F.explode("s.spans").alias("x"))
        events = F.coalesce(F.flatten(F.transform(F.col("x.events"), lambda e: F.concat(own("event", e["name"]), keys(e["attributes"])))), none)
        names = F.concat(own("span", F.col("x.name")), keys(F.col("x.attributes")), events)
    elif signal == "logs":
        s = base.select("service", "version", F.explode("r.scopeLogs").alias("s"))
        x = s.select("service", "version", F.col("s.scope.name").alias("scope"), F.explode("s.logRecords").alias("x"))
        names = F.concat(own("event", F.col("x.eventName")), keys(F.col("x.attributes")))
    else:
        s = base.select("service", "version", F.explode("r.scopeMetrics").alias("s"))
        x = s.select("service", "version", F.col("s.scope.name").alias("scope"), F.explode("s.metrics").alias("x"))
        points = [F.coalesce(F.flatten(F.transform(F.col(f"x.{f}.dataPoints"), lambda p: keys(p["attributes"]))), none)
                  for f in ("gauge", "sum", "histogram", "exponentialHistogram", "summary")]
        names = F.concat(own("metric", F.col("x.name")), *points)
    return x.select("service", "version", "scope", F.explode(names).alias("n")).select(
        "service", "version", "scope", "n.kind", "n.name").filter(F.coalesce("name", F.lit("")) != "")


def undeclared(counts: DataFrame, registry: DataFrame) -> DataFrame:
    """Name counts ``service, version, kind, name, count`` a known registry does not declare.

    Names are counted before the joins, so the joins see distinct names and not records. Templates
    are matched on the name's own dotted prefixes by an equi-join, never by comparing all pairs.
    """
    declared = registry.filter(~F.col("is_template") & (F.col("kind") != "limit")).select(
        F.col("tool").alias("service"), "version", F.when(F.col("kind") == "standard", "attribute").otherwise(F.col("kind")).alias("kind"), "name").distinct()
    known = registry.select(F.col("tool").alias("service"), "version").distinct()
    templates = registry.filter("is_template").select(F.col("tool").alias("service"), "version", F.col("name").alias("_prefix")).distinct()
    rest = counts.join(known, ["service", "version"], "left_semi").join(declared, ["service", "version", "kind", "name"], "left_anti")
    bits = F.split("name", r"\.")
    prefixes = F.when(F.size(bits) > 1, F.transform(F.sequence(F.lit(1), F.size(bits) - 1),
                                                   lambda i: F.concat(F.array_join(F.slice(bits, F.lit(1), i), "."), F.lit("."))))
    hit = (rest.filter("kind = 'attribute'").select("service", "version", "name", F.explode(prefixes).alias("_prefix"))
           .filter(F.length("name") > F.length("_prefix")).join(templates, ["service", "version", "_prefix"], "left_semi")
           .select("service", "version", F.lit("attribute").alias("kind"), "name").distinct())
    return rest.join(hit, ["service", "version", "kind", "name"], "left_anti")


def capped(counts: DataFrame, keys: Sequence[str], order: Sequence[Column | str], cap: int | None = None) -> DataFrame:
    """All distinct names with their counts; with a cap, for a report that wants one, the first ``cap`` distinct names in a given order with their counts, and one overflow row
    (``name`` NULL) that holds the count of the rest, so nothing is lost."""
    if cap is None:
        return counts.select(*keys, "count", F.lit(False).alias("overflow"))
    first = counts.orderBy(*order).limit(cap).withColumn("overflow", F.lit(False))
    rest = counts.join(first.select(*keys), list(keys), "left_anti").agg(F.sum("count").alias("count"))
    over = rest.filter("count IS NOT NULL").select(*[F.lit(None).cast("string").alias(k) for k in keys], "count", F.lit(True).alias("overflow"))
    return first.select(*keys, "count", "overflow").unionByName(over)


def check_names(raw: DataFrame, registry: DataFrame, cap: int | None = None) -> DataFrame:
    """Counts of all the names (by their full text) a tool's registry does not declare, by service, version and name."""
    counts = used_names(raw).groupBy("service", "version", "kind", "name").agg(F.count(F.lit(1)).alias("count"))
    each = undeclared(counts, registry).groupBy("service", "version", "name").agg(F.sum("count").alias("count"))
    return capped(each, ["service", "version", "name"], ["service", "version", "name"], cap)


def mark_unknown(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Resources whose service and version have no registry, marked. A line that holds resources of
    several tools comes out as one line a tool."""
    signal, column = _signal_of(raw)
    depth = _depth(raw)
    kv = _kv(depth)
    res_t = full(signal, depth)[column].dataType.elementType

    def pair(r: Column) -> Column:
        text = lambda k: F.coalesce(F.get(F.transform(F.filter(r["resource"]["attributes"], lambda a: a["key"] == k), lambda a: a["value"]["stringValue"]), F.lit(0)), F.lit(""))
        return F.concat(text(cv.SERVICE_NAME), F.lit("\x1f"), text(cv.SERVICE_VERSION))
    # A line is told apart by its resources' distinct pairs; most lines have one.
    pairs = raw.withColumn("_pair", F.explode_outer(F.array_distinct(F.transform(F.col(column), pair))))
    known = registry.select(F.concat("tool", F.lit("\x1f"), "version").alias("_pair"), F.lit(True).alias("_known")).distinct()
    joined = pairs.join(known, "_pair", "left").withColumn("_bad", F.col("_known").isNull())

    def one(r: Column) -> Column:
        add = F.when(F.col("_bad") & (pair(r) == F.col("_pair")), F.array(_pair(cv.REGISTRY_MARK, F.lit("unknown"), kv))).otherwise(F.array().cast(kv))
        kept = F.filter(F.coalesce(r["resource"]["attributes"], F.array().cast(kv)), lambda a: a["key"] != cv.REGISTRY_MARK)
        return _fields(res_t, r, resource=_fields(res_t["resource"].dataType, r["resource"], attributes=F.concat(kept, add)))
    mine = F.filter(F.col(column), lambda r: pair(r) == F.col("_pair"))
    return joined.withColumn(column, F.transform(mine, one)).select(*raw.columns)


def unknown_vendor_names(raw: DataFrame, pinned: DataFrame, scope_prefix: str, cap: int | None = None) -> DataFrame:
    """Attribute names, keys only, that one vendor's scopes send and the pinned list lacks. Names not
    fit to keep, and those past a cap if one is given, are counted in one bucket."""
    mine = used_names(raw).filter((F.col("kind") == "attribute") & F.startswith("scope", F.lit(scope_prefix)))
    counts = mine.groupBy("name").agg(F.count(F.lit(1)).alias("count")).join(pinned, "name", "left_anti")
    safe = counts.groupBy(usable_name(F.col("name")).alias("name")).agg(F.sum("count").alias("count"))
    held = capped(safe, ["name"], [F.col("name") != cv.UNUSABLE, "name"], cap)
    return held.groupBy(F.coalesce("name", F.lit(cv.UNUSABLE)).alias("name")).agg(F.sum("count").alias("count"))


def within_budget(lines: DataFrame, budgets: DataFrame, run: str = "run", file: str = "file", offset: str = "offset",
                  size: str = "bytes", default: int = cv.DEFAULT_RUN_BUDGET, spent: DataFrame | None = None) -> DataFrame:
    """Lines with ``kept`` and ``over_budget``: a run is read in file order until its bytes no longer fit.
    ``spent`` has the bytes (column of that name) that a run's lines took before these.

    The running total is spread over the cluster by run, file and offset, so a run with a third of all
    lines is many tasks' work.
    """
    upto = running_total(lines, [run], [file, offset], size, "_upto", "_total")
    limit = F.coalesce("budget", F.lit(default))
    upto = upto.join(budgets.select(run, "budget"), run, "left")
    upto = upto.join(spent.select(run, "spent"), run, "left") if spent is not None else upto.withColumn("spent", F.lit(0))
    before = F.coalesce("spent", F.lit(0))
    return (upto.withColumn("kept", before + F.col("_upto") <= limit).withColumn("over_budget", before + F.col("_total") > limit)
            .drop("_upto", "_total", "budget", "spent"))
