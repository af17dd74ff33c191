"""Object keys as columns: what a path says about its object, and the time it covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracehold import conventions as cv


def _part(key: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(key, pattern, group), F.lit(""))


def _time(key: Column, pattern: str, shape: str, *prefixes: str) -> Column:
    """A real date and hour from a pattern's groups; NULL for a 31 February, an hour 25 or another shape.

    One pass of one pattern, and only for keys under its prefixes.
    """
    under = F.lit(False)
    for p in prefixes:
        under = under | F.startswith(key, F.lit(p))
    return F.when(under, F.try_to_timestamp(F.regexp_replace(key, pattern, shape), F.lit("yyyy-MM-dd HH")))


def _batch_time(key: Column, *signals: str) -> Column:
    return _time(key, cv.BATCH_KEY, "$2-$3-$4 $5", *[s + "/" for s in signals])


def batch_hour(key: Column, signal: str) -> Column:
    """``yyyy-mm-dd-hh`` of a well-formed batch key of one signal, else NULL."""
    return F.date_format(_batch_time(key, signal), "yyyy-MM-dd-HH")


def parse_key(key: Column) -> Column:
    """``struct<kind, signal, start, end, rollup, collector, source, tool, version, sha256, n, manifest>``.

    ``kind`` is batch, compacted, index, daily, monthly, registry or ignored. Single part files and the
    store's own folders are both known; anything that is not of exactly a shape a writer makes is ignored, so a stray file never becomes data.
    """
    own_part = _time(key, cv.STORE_PART_KEY, "$2-$3-$4 $5", "compacted/signal=")
    batch, part = _batch_time(key, *cv.SIGNALS), F.coalesce(own_part, _time(key, cv.PART_KEY, "$2-$3-$4 $5", "compacted/"))
    index = F.coalesce(_time(key, cv.STORE_INDEX_KEY, "$1-$2-$3 00", "index/items/day="), _time(key, cv.INDEX_KEY, "$1-$2-$3 00", "index/"))
    daily = F.coalesce(_time(key, cv.STORE_DAILY_KEY, "$2-$3-$4 00", *[f"rollups/{k}/daily/day=" for k in ("runs", "metrics")]), _time(key, cv.DAILY_KEY, "$2-$3-$4 00", "rollups/"))
    monthly = F.coalesce(_time(key, cv.STORE_MONTHLY_KEY, "$2-$3-01 00", *[f"rollups/{k}/monthly/day=" for k in ("runs", "metrics")]), _time(key, cv.MONTHLY_KEY, "$2-$3-01 00", "rollups/"))
    registry = key.rlike(cv.REGISTRY_KEY)
    kind = (F.when(batch.isNotNull(), "batch").when(part.isNotNull(), "compacted").when(index.isNotNull(), "index")
            .when(daily.isNotNull(), "daily").when(monthly.isNotNull(), "monthly")
            .when(registry, "registry").otherwise("ignored"))
    start = F.coalesce(batch, part, index, daily, monthly)
    end = (F.when(batch.isNotNull() | part.isNotNull(), start + F.expr("INTERVAL 1 HOUR"))
           .when(index.isNotNull() | daily.isNotNull(), start + F.expr("INTERVAL 1 DAY"))
           .when(monthly.isNotNull(), F.add_months(start, 1).cast("timestamp")))
    numbered = (F.when(own_part.isNotNull(), F.regexp_extract(key, cv.STORE_PART_KEY, 6).try_cast("int"))
                .when(part.isNotNull(), F.regexp_extract(key, r"-(\d+)\.(parquet|json)$", 1).try_cast("int")))
    return F.struct(
        kind.alias("kind"),
        F.when(batch.isNotNull(), _part(key, cv.BATCH_KEY, 1)).when(own_part.isNotNull(), _part(key, cv.STORE_PART_KEY, 1)).when(part.isNotNull(), _part(key, cv.PART_KEY, 1)).alias("signal"),
        start.alias("start"), end.alias("end"), (daily.isNotNull() | monthly.isNotNull()).alias("rollup"),
        F.when(batch.isNotNull(), _part(key, cv.BATCH_KEY, 6)).when(registry, _part(key, cv.REGISTRY_KEY, 1)).alias("collector"),
        F.when(batch.isNotNull(), _part(key, cv.BATCH_KEY, 8)).alias("source"),
        _part(key, cv.REGISTRY_KEY, 2).alias("tool"), _part(key, cv.REGISTRY_KEY, 3).alias("version"),
        _part(key, cv.REGISTRY_KEY, 4).alias("sha256"),
        numbered.alias("n"), F.when(part.isNotNull(), F.endswith(key, F.lit(".json"))).alias("manifest"))


def key_span(key: Column) -> Column:
    """``struct<start, end, rollup>`` of a key retention may touch, else NULL."""
    p = parse_key(key)
    return F.when(p["start"].isNotNull(), F.struct(p["start"].alias("start"), p["end"].alias("end"), p["rollup"].alias("rollup")))
