"""Decoding OTLP JSON: attribute lists, numbers that may be strings, times and enums.

Attribute lists are ``array<struct<k,v>>``, not maps: a duplicate or null key is data here, and a
Spark map would raise on it. Lookups use ``array_position``/``get`` over the key and value arrays,
which stay inside whole-stage codegen, rather than a lambda per lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.schemas import ATTRS, VALUE_FIELDS

UNIT = "\x1f"  # joins the wanted labels in one text parameter


def row(**fields: Column) -> Column:
    """A struct with fixed field names; unlike aliases they hold inside a lambda too."""
    return F.named_struct(*[x for n, c in fields.items() for x in (F.lit(n), c)])


def otel_str(v: Column) -> Column:
    """Any attribute value as text; arrays and maps as JSON."""
    return F.coalesce(*[v[f] for f in VALUE_FIELDS])


def otel_attrs(l: Column) -> Column:
    """A KeyValue list as ``array<struct<k,v>>``; NULL becomes empty."""
    pairs = F.transform(l, lambda a: row(k=a["key"], v=otel_str(a["value"])))
    return F.coalesce(pairs, F.array().cast(ATTRS))


def attr(l: Column, key: str | Column) -> Column:
    """The first value of a key, or NULL."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.get(l.getField("v"), F.array_position(l.getField("k"), key).cast("int") - F.lit(1))


def pick(resource: Column, attributes: Column, key: str | Column) -> Column:
    """The resource's value of a key, else the record's."""
    return F.coalesce(attr(resource, key), attr(attributes, key))


def own_projection(l: Column) -> Column:
    """An attribute list as it is, by a higher-order function: these are not part of whole-stage code, so the
    projection that holds one is compiled by itself, in methods of a size the JVM compiles. The promoted
    columns in one method of a whole stage are over that size and run interpreted, at twice the time."""
    return F.filter(l, lambda a: F.lit(True))


def otel_text(j: Column) -> Column:
    return F.btrim(j, F.lit('"'))


def otel_num(j: Column) -> Column:
    return otel_text(j).try_cast("double")


def otel_ns(j: Column) -> Column:
    """Nanoseconds as a 38-digit decimal, or NULL."""
    return otel_text(j).try_cast("decimal(38,0)")


def _small_ns(j: Column) -> Column:
    # Nanoseconds to the year 2262 fit a bigint; the decimal path runs only for text that does not.
    return otel_text(j).try_cast("bigint")


def otel_time(j: Column) -> Column:
    """A microsecond timestamp where the nanoseconds are positive, else NULL."""
    small = _small_ns(j)
    micros = (F.when(small.isNotNull(), F.call_function("div", small, F.lit(1000)))
              .otherwise(F.floor(otel_ns(j) / F.lit(1000)).try_cast("bigint")))
    return F.when(micros >= 1, F.timestamp_micros(micros)).when(
        (micros == 0) & (otel_ns(j) > 0), F.timestamp_micros(micros))


def span_duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end nanoseconds, as a double."""
    s, e = _small_ns(start), _small_ns(end)
    return (F.when(s.isNotNull() & e.isNotNull(), F.try_subtract(e, s).cast("double"))
            .otherwise((otel_ns(end) - otel_ns(start)).cast("double"))) / F.lit(1e6)


def _enum(j: Column, prefix: str, names: Sequence[str], default: str | None) -> Column:
    """OTLP enums come as a number or as an upper-case name."""
    text, out = otel_text(j), None
    for i, name in enumerate(names, start=1):
        hit = text.isin(str(i), prefix + name.upper())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if default else out


def otel_kind(j: Column) -> Column:
    return _enum(j, "SPAN_KIND_", ("internal", "server", "client", "producer", "consumer"), "unspecified")


def otel_status(j: Column) -> Column:
    return _enum(j, "STATUS_CODE_", ("ok", "error"), "unset")


def otel_temporality(j: Column) -> Column:
    return _enum(j, "AGGREGATION_TEMPORALITY_", ("delta", "cumulative"), None)


def labels_of(resource: Column, prefix: str = cv.LABEL_PREFIX) -> Column:
    """The resource's labels as a map: the key without its prefix, its first value, no nulls."""
    n = len(prefix)
    own = F.filter(resource, lambda a: F.startswith(a["k"], F.lit(prefix))
                   & (F.length(a["k"]) > n) & a["v"].isNotNull())
    pairs = F.transform(own, lambda a: row(k=F.substring(a["k"], n + 1, 1 << 30), v=a["v"]))
    first = F.filter(pairs, lambda e, i: F.array_position(pairs.getField("k"), e["k"]) == i + 1)
    return F.map_from_entries(first)


def labels_match(labels: Column, want: Sequence[str] | Column) -> Column:
    """True when every wanted ``key:value`` is in the map. No wish matches all; a NULL map, none."""
    if isinstance(want, Column):
        def hit(w: Column) -> Column:
            at = F.instr(w, ":")
            return F.coalesce(F.try_element_at(labels, F.split_part(w, F.lit(":"), F.lit(1)))
                              == F.substr(w, at + F.lit(1)), F.lit(False))
        return (want == "") | F.forall(F.split(want, UNIT), hit)
    out = F.lit(True)
    for label in want:
        key, _, value = label.partition(":")
        out = out & F.coalesce(F.try_element_at(labels, F.lit(key)) == F.lit(value), F.lit(False))
    return out


def labels_param(labels: Sequence[str]) -> str:
    return UNIT.join(labels)


def erased(v: Column, handles: Sequence[str]) -> Column:
    return v.isin(*handles) if handles else F.lit(False)


def mask_attrs(l: Column, handles: Sequence[str]) -> Column:
    """Replace an erased handle in every ``user.name`` of an attribute list."""
    if not handles:
        return l
    hit = lambda a: (a["k"] == cv.USER_NAME) & a["v"].isin(*handles)
    return F.transform(l, lambda a: row(
        k=a["k"], v=F.when(hit(a), F.lit(cv.ERASED)).otherwise(a["v"])))


def mask_actor(actor: Column, handles: Sequence[str]) -> Column:
    return F.when(erased(actor, handles), F.lit(cv.ERASED)).otherwise(actor) if handles else actor


def holds_erased(resource: Column, attributes: Column, handles: Sequence[str]) -> Column:
    """True when any attribute of either list still names an erased person."""
    hit = lambda a: (a["k"] == cv.USER_NAME) & a["v"].isin(*handles)
    if not handles:
        return F.lit(False)
    return F.coalesce(F.exists(resource, hit) | F.exists(attributes, hit), F.lit(False))


def promote(resource: Column, attributes: Column, c: cv.Conventions = cv.DEFAULT) -> dict[str, Column]:
    """The promoted columns, in the tables' order."""
    out: dict[str, Column] = {}
    for name, keys in c.promoted.items():
        value = F.coalesce(*[pick(resource, attributes, k) for k in keys])
        out[name] = value.try_cast("timestamp") if name == "received_at" else value
    out["labels"] = labels_of(resource, c.label_prefix)
    return out


def log_body(body: Column) -> Column:
    """A log body's string, else its whole JSON text. ``body`` is the JSON text of the value."""
    return F.coalesce(F.get_json_object(body, "$.stringValue"), body)


def event_name(own: Column, attributes: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), attr(attributes, cv.EVENT_NAME))


def lower_id(v: Column) -> Column:
    return F.nullif(F.lower(v), F.lit(""))
