"""The user's way in: named queries and SQL over a store."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.functions.sql import register
from tracehold.functions.text import check_label
from tracehold.operators.dedupe import one_per_record
from tracehold.plans import catalogue
from tracehold.plans.store import Store, window_hours
from tracehold.session import utc
from tracehold.sources.results import result_meta


@dataclass(frozen=True)
class Named:
    help: str
    since: dt.timedelta
    signals: tuple[str, ...]
    arg: str = ""
    rollups: bool = False


QUERIES: dict[str, Named] = {
    "cost": Named("cost and tokens of runs by model", dt.timedelta(days=7), ("traces",), rollups=True),
    "item": Named("one work item's steps, runs and events in order", dt.timedelta(days=7), ("traces", "logs"), arg="item key"),
    "items": Named("work items seen lately and how they last ended", dt.timedelta(days=7), ("traces",)),
    "recent": Named("the newest runs and their traces", dt.timedelta(days=1), ("traces",)),
    "runs": Named("runs of each lane by outcome", dt.timedelta(days=1), ("traces",), rollups=True),
    "trace": Named("the spans of one trace as a tree", dt.timedelta(days=7), ("traces",), arg="trace id"),
}
LONG_RANGE = dt.timedelta(days=cv.LONG_RANGE_DAYS)
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


def parse_when(text: str, now: dt.datetime) -> dt.datetime:
    """``7d``, ``24h``, ``1h30m`` back from now, or an RFC 3339 time, in UTC."""
    if re.fullmatch(r"\d+d", text):
        return now - dt.timedelta(days=int(text[:-1]))
    if re.fullmatch(r"(\d+(\.\d+)?(ns|us|µs|ms|s|m|h))+", text):
        seconds = sum(float(n) * _UNITS[u] for n, _, u in re.findall(r"(\d+(\.\d+)?)(ns|us|µs|ms|s|m|h)", text))
        return now - dt.timedelta(seconds=seconds)
    if re.match(r"^-", text):
        raise ValueError("give a duration back from now, without a sign")
    if not re.match(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$", text):
        raise ValueError(f"{text!r} is neither a duration (24h, 7d) nor an RFC 3339 time")
    t = dt.datetime.fromisoformat(text)
    return t.astimezone(dt.timezone.utc).replace(tzinfo=None)


class Engine:
    """Named queries and SQL over one store, as DataFrames."""

    def __init__(self, spark: SparkSession, root: str, erased: Sequence[str] = (), now: dt.datetime | None = None, **options):
        self.spark, self.store = spark, Store(spark, root, erased, **options)
        self._now = now
        self.from_rollups, self.window, self._read = False, None, []

    @property
    def now(self) -> dt.datetime:
        return self._now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

    def names(self) -> DataFrame:
        """The catalogue."""
        return self.spark.createDataFrame(
            [(n, q.help, q.arg, int(q.since.total_seconds())) for n, q in sorted(QUERIES.items())],
            "name string, help string, argument string, since_seconds bigint")

    def resolve(self, name: str, arg: str | None, since, until, labels: Sequence[str]) -> tuple[dt.datetime, dt.datetime]:
        """The window of a query, after its arguments were checked."""
        if name not in QUERIES:
            raise ValueError(f"no query {name!r}")
        q, now = QUERIES[name], self.now
        when = lambda v, default: default if v is None else parse_when(v, now) if isinstance(v, str) else v
        start, end = when(since, now - q.since), when(until, now)
        if q.arg and not (arg or "").strip():
            raise ValueError(f"{name} needs {q.arg}")
        if not q.arg and arg:
            raise ValueError(f"{name} takes no argument")
        if not start < end:
            raise ValueError("since must be before until")
        if labels and q.rollups and end - start > LONG_RANGE:
            raise ValueError(f"{name} over more than {cv.LONG_RANGE_DAYS} days reads rollups, which keep no labels; narrow the window")
        for l in labels:
            check_label(l)
        return start, end

    @staticmethod
    def _once(copies: DataFrame, wanted) -> DataFrame:
        """The records of which a copy is wanted, each once. A narrow pass finds their ids with the filter at
        the scan, so only these records' copies are shuffled. Which copy counts is decided among all
        copies, so the caller filters again; records without an id count as one record."""
        ids = copies.filter(wanted).select(F.col("record_id").alias("_id")).distinct()
        return one_per_record(copies.join(ids, copies["record_id"].eqNullSafe(ids["_id"]), "left_semi"))

    def _copies(self, signal: str, hours: Sequence[dt.datetime], item: str | None = None) -> DataFrame:
        """The copies of a signal's records in some hours, of which those that hold an item; what is read is kept for ``describe``."""
        states = self.store.state(signal, hours)
        states = states if item is None else self.store.item_hours(item, states)
        self._read += states
        return self.store.copies(signal, states).drop("hour")

    def query(self, name: str, arg: str | None = None, since=None, until=None, lane: str = "", labels: Sequence[str] = ()) -> DataFrame:
        start, end = self.window = self.resolve(name, arg, since, until, labels)
        self.from_rollups, self._read = QUERIES[name].rollups and end - start > LONG_RANGE, []
        if self.from_rollups:
            rows = self.store.rollup_source("runs", start, end)
            return (catalogue.runs_from_rollups if name == "runs" else catalogue.cost_from_rollups)(rows, lane)
        hours = window_hours(start, end)
        if name == "trace":
            # Copies share their trace, so one trace is picked before copies are removed.
            copies = self._copies("traces", hours)
            return catalogue.trace(one_per_record(copies.filter(F.col("trace_id") == arg.lower())), arg, start, end)
        if name == "item":
            s, l = (self._once(self._copies(g, hours, arg), F.col("item_key") == arg)
                    for g in ("traces", "logs"))
            return catalogue.item(s, l, arg, start, end, labels)
        copies = self._copies("traces", hours)
        mine = F.col("item_key").isNotNull() if name == "items" else F.col("name") == self.store.c.run_span
        spans = self._once(copies, mine & catalogue.in_window(start, end) & (F.col("lane") == lane if lane else F.lit(True)))
        if name == "items":
            return catalogue.items(spans, start, end, lane, labels)
        return {"runs": catalogue.runs, "recent": catalogue.recent, "cost": catalogue.cost}[name](
            spans, start, end, lane, labels, self.store.c)

    def describe(self, df: DataFrame, name: str, **params) -> DataFrame:
        """What the last answer was asked and what it rests on: its window, whether it comes from rollups, the
        parts and uncovered batches it reads otherwise, and how many damaged batches of the store it cannot hold."""
        read = {"parts": sum(s.n > 0 for s in self._read), "batches": self.store.batch_files(self._read).count()}
        damaged = self.store.quarantined().filter("kind = 'damaged'").count()
        start, end = self.window or (None, None)
        return result_meta(df, name, params | {"since": start, "until": end, "from_rollups": self.from_rollups, "damaged": damaged} | ({} if self.from_rollups else read))

    def sql(self, text: str, since: dt.datetime, until: dt.datetime, **params) -> DataFrame:
        """SQL over ``spans``, ``logs`` and ``metric_points`` received in a window, with named parameters."""
        register(self.spark, self.store.erased)
        hours = window_hours(since, until)
        for signal, table in cv.TABLES.items():
            self.store.table(signal, hours).createOrReplaceTempView(table)
        return self.spark.sql(text, args={"since": utc(since), "until": utc(until), **params})
