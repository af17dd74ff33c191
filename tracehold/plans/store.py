"""The store: batches by receipt hour, compacted parts with manifests, an item index and rollups.

    <signal>/<yyyy>/<mm>/<dd>/<hh>/<collector>/*.jsonl.gz         batches, as collectors ship them
    compacted/signal=<s>/hour=<yyyy-mm-dd-hh>/n=<n>/*.parquet     parts
    manifests/signal=<s>/hour=<h>/*.parquet                       one row per batch a part covers
    index/items/day=<yyyy-mm-dd>/*.parquet                        item index and its coverage
    rollups/<kind>/<daily|monthly>/day=<yyyy-mm-dd>/*.parquet     rollups
    quarantine/files/<batch's key>                                batches that end before they say
    quarantine/lines/signal=<s>/*.parquet                         lines of covered batches that hold no record

The driver handles hours and days, whose number the window bounds, and never a list of files or
records. A part without a manifest does not exist for a reader; manifests are written last.
"""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.functions import otel
from tracehold.operators.dedupe import content_order, keep_one, one_per_record
from tracehold.operators.flatten import flatten_logs, flatten_points, flatten_spans
from tracehold.plans import rollups
from tracehold.schemas import ITEM_INDEX, MANIFEST, ROLLUPS, TABLE
from tracehold.session import cut, nothing, prepare, utc
from tracehold.sources.batches import list_files, read_batches, unreadable_lines, whole_files
from tracehold.sources.keys import batch_hour
from tracehold.sources.parts import read_parts, write_sorted

HOUR = "%Y-%m-%d-%H"
#: Files that are deleted at one time.
DELETES = 32
#: Covered batches that a read leaves out by name; more are left out by a join.
BY_NAME = 1024
_FLATTEN = {"traces": flatten_spans, "logs": flatten_logs, "metrics": flatten_points}


def batch_key(path: Column) -> Column:
    """A batch's key under the root, so that a manifest holds however the root is spelled and wherever it moves."""
    return F.substring_index(path, "/", -7)


def hour_text(h: dt.datetime) -> str:
    return h.strftime(HOUR)


def floor_hour(t: dt.datetime) -> dt.datetime:
    return t.replace(minute=0, second=0, microsecond=0)


def window_hours(since: dt.datetime, until: dt.datetime) -> list[dt.datetime]:
    """The receipt hours that can hold a window's records, an hour either side for clock skew."""
    h, out, end = floor_hour(since) - dt.timedelta(hours=1), [], until + dt.timedelta(hours=1)
    while h <= end:
        out.append(h)
        h += dt.timedelta(hours=1)
    return out


@dataclass
class HourState:
    """What a reader knows of one signal's hour."""

    signal: str
    hour: str
    n: int = 0              # the trusted part's number, 0 before the first compaction
    batches: bool = False   # whether a batch folder exists


class Store:
    """One store folder on any file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str, erased: Sequence[str] = (), identity: str = "logical",
                 c: cv.Conventions = cv.DEFAULT):
        self.spark, self.root, self.erased, self.identity, self.c = prepare(spark), root.rstrip("/"), list(erased), identity, c
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- folders ------------------------------------------------------------------------------
    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _exists(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{folder}"))

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def _values(self, folder: str, prefix: str) -> set[str]:
        return {n.removeprefix(prefix) for n in self._names(folder) if n.startswith(prefix)}

    def _batch_hours(self, signal: str, hours: Iterable[dt.datetime]) -> set[str]:
        wanted = set(hours)
        out: set[str] = set()
        for day in sorted({h.date() for h in wanted}):
            for name in self._names(f"{signal}/{day:%Y/%m/%d}"):
                if name.isdigit() and int(name) < 24:
                    h = dt.datetime.combine(day, dt.time(int(name)))
                    if h in wanted:
                        out.add(hour_text(h))
        return out

    def _batch_dir(self, signal: str, hour: str) -> str:
        return f"{self.root}/{signal}/{hour.replace('-', '/')}"

    # --- manifests ----------------------------------------------------------------------------
    def manifests(self, signal: str, hours: Sequence[str]) -> DataFrame:
        """Manifest rows of some hours, every number; ``batch`` is a key under the root, also where an older
        manifest holds a whole path."""
        have = self._values(f"manifests/signal={signal}", "hour=") & set(hours)
        if not have:
            return nothing(self.spark, MANIFEST)
        base = f"{self.root}/manifests"
        return (self.spark.read.schema(MANIFEST).option("basePath", base)
                .parquet(*[f"{base}/signal={signal}/hour={h}" for h in sorted(have)]).withColumn("batch", batch_key(F.col("batch"))))

    def latest(self, signal: str, hours: Sequence[str]) -> DataFrame:
        """Each hour's newest manifest rows, those that name their own hour's part."""
        m = self.manifests(signal, hours)
        newest = m.groupBy("signal", "hour").agg(F.max("n").alias("n"))
        return m.join(newest, ["signal", "hour", "n"])

    def part_name(self, signal: Column, hour: Column, n: Column) -> Column:
        return F.concat(F.lit("compacted/signal="), signal, F.lit("/hour="), hour, F.lit("/n="), n.cast("string"))

    def state(self, signal: str, hours: Sequence[dt.datetime]) -> list[HourState]:
        """The read plan of some hours: the trusted part and whether batches lie beside it."""
        hours = sorted({floor_hour(h) for h in hours})
        names = [hour_text(h) for h in hours]
        per_hour = self.manifests(signal, names).groupBy("hour").agg(
            F.max("n").alias("n"), F.max_by("part", "n").alias("part"))
        newest = {}
        for r in per_hour.select("hour", "n", "part", self.part_name(F.lit(signal), F.col("hour"), F.col("n")).alias("own")).collect():
            if r.part != r.own:
                raise ValueError(f"the manifest of {signal} {r.hour} names a part outside its hour: {r.part}")
            newest[r.hour] = r.n
        with_batches = self._batch_hours(signal, hours)
        return [HourState(signal, h, newest.get(h, 0), h in with_batches) for h in names if h in newest or h in with_batches]

    def batch_files(self, states: Sequence[HourState]) -> DataFrame:
        """``signal, hour, path`` of the well-formed batches in some hours that no trusted part covers."""
        dirs = [self._batch_dir(s.signal, s.hour) for s in states if s.batches]
        files = list_files(self.spark, dirs, "*.jsonl.gz")
        files = files.withColumn("batch", batch_key(F.col("path")))
        key = F.col("batch")
        files = files.withColumn("signal", F.split_part(key, F.lit("/"), F.lit(1)))
        hour = F.coalesce(*[batch_hour(key, s) for s in cv.SIGNALS])
        files = files.withColumn("hour", hour).filter("hour IS NOT NULL").select("signal", "hour", "batch", "path", "size")
        for signal in {s.signal for s in states if s.n}:
            held = self.latest(signal, [s.hour for s in states if s.signal == signal and s.n])
            files = files.join(held.select("signal", "batch"), ["signal", "batch"], "left_anti")
        return files.select("signal", "hour", "path", "size")

    def read_plan(self, signals: Sequence[str], since: dt.datetime, until: dt.datetime) -> DataFrame:
        """``signal, hour, kind, path`` of what a window reads: trusted parts and uncovered batches."""
        hours = window_hours(since, until)
        out = nothing(self.spark, "signal string, hour string, kind string, path string")
        for signal in signals:
            st = self.state(signal, hours)
            parts = [(s.signal, s.hour, "part", f"{self.root}/compacted/signal={s.signal}/hour={s.hour}/n={s.n}") for s in st if s.n]
            out = out.union(self.spark.createDataFrame(parts, out.schema)).union(
                self.batch_files(st).select("signal", "hour", F.lit("batch").alias("kind"), "path"))
        return out

    # --- records ------------------------------------------------------------------------------
    def _flat(self, signal: str, raw: DataFrame) -> DataFrame:
        extra = {} if signal == "traces" else {"identity": self.identity}
        return _FLATTEN[signal](raw, erased=self.erased, c=self.c, keep=("hour",), **extra)

    def _received(self, signal: str, dirs: Sequence[str], strict: bool = False, covered: DataFrame | None = None) -> DataFrame:
        """Well-formed batches of some hour folders as nested rows with their receipt ``hour``, without those a
        part covers. A strict read fails at what it cannot read, a storage fault included, instead of passing over it."""
        def uncovered(lines: DataFrame) -> DataFrame:
            paths = [r.path for r in covered.select("path").limit(BY_NAME + 1).collect()]
            if len(paths) <= BY_NAME:  # their names are left out where Spark lists files, so they are not opened
                return lines.filter(~F.col("file").isin(paths)) if paths else lines
            return lines.join(covered.select("batch"), batch_key(F.col("file")) == F.col("batch"), "left_anti")
        raw = read_batches(self.spark, signal, dirs, skip_corrupt=not strict, only=None if covered is None else uncovered)
        return raw.withColumn("hour", batch_hour(batch_key(F.col("file")), signal)).filter("hour IS NOT NULL")

    def copies(self, signal: str, states: Sequence[HourState], strict: bool = False) -> DataFrame:
        """Every copy of the records in some hours with their receipt ``hour``; parts and uncovered batches."""
        table = [*TABLE[signal].fieldNames(), "hour"]
        parts = [s for s in states if s.n]
        base = f"{self.root}/compacted/signal={signal}"
        held = read_parts(self.spark, signal, [f"{base}/hour={s.hour}/n={s.n}" for s in parts], self.erased,
                          ["hour", "n"], base).select(*table)
        # Hours without a part are read as they are. Beside a part, batches it covers are left out by a
        # join on those that still lie there, which pruning keeps to the last compactions: few enough
        # for Spark to broadcast, and its skew join splits a large file otherwise.
        plain = [self._batch_dir(signal, s.hour) for s in states if s.batches and not s.n]
        mixed = [s for s in states if s.batches and s.n]
        if not plain and not mixed:
            return held
        raw = self._received(signal, plain, strict)
        if mixed:
            dirs = [self._batch_dir(signal, s.hour) for s in mixed]
            covered = (list_files(self.spark, dirs, "*.jsonl.gz").select("path", batch_key(F.col("path")).alias("batch"))
                       .join(self.latest(signal, [s.hour for s in mixed]).select("batch"), "batch", "left_semi"))
            raw = raw.unionByName(self._received(signal, dirs, strict, covered))
        return held.unionByName(self._flat(signal, raw).select(*table))

    def table(self, signal: str, hours: Sequence[dt.datetime]) -> DataFrame:
        """A signal's records received in some hours, each once over all of them."""
        return one_per_record(self.copies(signal, self.state(signal, hours)).drop("hour"))

    def by_day(self, signal: str, days: Sequence[dt.date]) -> DataFrame:
        """A signal's records of some receipt days with their ``day``, each once a day."""
        hours = [dt.datetime.combine(d, dt.time(h)) for d in days for h in range(24)]
        df = self.copies(signal, self.state(signal, hours)).withColumn("day", F.to_date(F.substring("hour", 1, 10))).drop("hour")
        return keep_one(df, ["day", "record_id"], [F.col("file").asc_nulls_last(), content_order(df)])

    # --- compaction ---------------------------------------------------------------------------
    def closed_hours(self, now: dt.datetime, lookback: dt.timedelta, grace: dt.timedelta) -> list[dt.datetime]:
        h, last, out = floor_hour(now - lookback), floor_hour(now - dt.timedelta(hours=1) - grace), []
        while h <= last:
            out.append(h)
            h += dt.timedelta(hours=1)
        return out

    def hours_holding(self, signal: str, hours: Sequence[dt.datetime]) -> set[str]:
        """Hours whose trusted parts still name an erased person."""
        parts = [s for s in self.state(signal, hours) if s.n]
        if not self.erased or not parts:
            return set()
        base = f"{self.root}/compacted/signal={signal}"
        df = read_parts(self.spark, signal, [f"{base}/hour={s.hour}/n={s.n}" for s in parts], (), ["hour", "n"], base)
        hit = otel.erased(F.col("actor"), self.erased) | otel.holds_erased(F.col("resource"), F.col("attributes"), self.erased)
        return {r.hour for r in df.filter(hit).select("hour").distinct().collect()}

    def compact(self, now: dt.datetime, grace: dt.timedelta = dt.timedelta(minutes=10), keep: dt.timedelta = dt.timedelta(hours=1),
                lookback: dt.timedelta = dt.timedelta(days=7)) -> DataFrame:
        """Compact every due hour in one job per signal, then prune, index and roll up what changed.

        Returns ``signal, hour, n, records`` of the parts written.
        """
        closed = self.closed_hours(now, lookback, grace)
        written = nothing(self.spark, "signal string, hour string, n int, records bigint")
        touched: dict[str, set[str]] = {}
        purge: dict[str, set[str]] = {}
        for signal in cv.SIGNALS:
            st = self.state(signal, closed)
            holding = self.hours_holding(signal, closed)
            # The listing is written down before anything is read: a batch that lands meanwhile is read
            # again next time, and a batch the manifest names was certainly read.
            fresh = self.quarantine(signal, cut(self.batch_files(st), "batches"))
            due_hours = {r.hour for r in fresh.select("hour").distinct().collect()} | holding
            due = [s for s in st if s.hour in due_hours]
            if due:
                written = written.union(self._compact_signal(signal, due, fresh, now))
                touched[signal] = due_hours
            purge[signal] = holding
        for signal in cv.SIGNALS:
            self.prune(signal, closed, now, keep, purge[signal])
        days = {dt.datetime.strptime(h, HOUR).date() for s in cv.INDEXED_SIGNALS for h in touched.get(s, ())}
        days |= self.unindexed_days({h.date() for h in closed})
        if days:
            self.build_item_index(sorted(days))
        rolled = {dt.datetime.strptime(h, HOUR).date() for s in ("traces", "metrics") for h in touched.get(s, ())}
        self.refresh_rollups(now, rolled, lookback, grace)
        return written

    def quarantine(self, signal: str, fresh: DataFrame) -> DataFrame:
        """Of new batches (signal, hour, path) those that can be read whole. The others are moved to the
        quarantine, never covered by a part and never deleted; lines that hold no record are written down
        there before their batch is covered."""
        dirs = [self._batch_dir(signal, r.hour) for r in fresh.filter(F.col("signal") == signal).select("hour").distinct().collect()]
        if not dirs:
            return fresh
        checked = cut(fresh.join(whole_files(self.spark, dirs), "path", "left"), "checked")
        for r in checked.filter("NOT coalesce(whole, false)").select("path").toLocalIterator():
            key = "/".join(r.path.split("/")[-7:])
            to = self._path(f"{self.root}/quarantine/files/{key}")
            self._fs.mkdirs(to.getParent())
            self._fs.rename(self._path(r.path), to)
        whole = checked.filter("whole").drop("whole")
        lines = unreadable_lines(self.spark, signal, dirs).join(whole.select(F.col("path").alias("file")), "file", "left_semi")
        if f"signal={signal}" in self._names("quarantine/lines"):  # a pass that failed later has written them already
            done = self.spark.read.parquet(f"{self.root}/quarantine/lines/signal={signal}").select(batch_key(F.col("file")).alias("batch")).distinct()
            lines = cut(lines.join(done, batch_key(F.col("file")) == F.col("batch"), "left_anti"), "bad-lines")
        lines.withColumn("signal", F.lit(signal)).write.mode("append").partitionBy("signal").parquet(f"{self.root}/quarantine/lines")
        return whole

    def quarantined(self) -> DataFrame:
        """``kind, path, lines`` of what was kept aside: damaged batches, and batches with lines that hold no
        record, with their number."""
        files, none = f"{self.root}/quarantine/files", nothing(self.spark, "kind string, path string, lines bigint")
        if self._exists("quarantine/files"):
            none = none.unionByName(list_files(self.spark, [files], "*.jsonl.gz").select(F.lit("damaged").alias("kind"), "path", F.lit(None).cast("bigint").alias("lines")))
        if any(n.startswith("signal=") for n in self._names("quarantine/lines")):
            bad = self.spark.read.parquet(f"{self.root}/quarantine/lines")
            none = none.unionByName(bad.groupBy(F.col("status").alias("kind"), F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("lines")))
        return none

    def _compact_signal(self, signal: str, due: Sequence[HourState], fresh: DataFrame, now: dt.datetime) -> DataFrame:
        base = f"{self.root}/compacted/signal={signal}"
        # A number no folder has, so a part left by a crashed pass is never appended to.
        numbers = {s.hour: max([s.n, *(int(n) for n in self._values(f"compacted/signal={signal}/hour={s.hour}", "n=") if n.isdigit())]) + 1
                   for s in due}
        number = self.spark.createDataFrame([(h, n) for h, n in numbers.items()], "hour string, n int")
        number_of = F.try_element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col("hour"))
        rows = self.copies(signal, due, strict=True)
        rows = keep_one(rows, ["hour", "record_id"], [F.col("file").asc_nulls_last(), content_order(rows.drop("hour"))])
        rows = rows.withColumn("n", number_of).filter("n IS NOT NULL").withColumn("file", self.part_name(F.lit(signal), F.col("hour"), F.col("n")))
        write_sorted(rows, base, ["time", "record_id"], ["hour", "n"])
        counts = (read_parts(self.spark, signal, [f"{base}/hour={h}/n={n}" for h, n in numbers.items() if self._exists(
            f"compacted/signal={signal}/hour={h}/n={n}")], (), ["hour", "n"], base, check=False)
            .groupBy("hour").agg(F.count(F.lit(1)).alias("records")))
        old = self.latest(signal, [s.hour for s in due if s.n]).select("hour", "batch")
        covers = old.unionByName(fresh.select("hour", batch_key(F.col("path")).alias("batch"))).distinct()
        manifest = (number.join(counts, "hour", "left").join(covers, "hour", "left")
                    .select(F.lit(signal).alias("signal"), "hour", "n", self.part_name(F.lit(signal), F.col("hour"), F.col("n")).alias("part"),
                            "batch", F.coalesce("records", F.lit(0)).cast("bigint").alias("records"), F.lit(utc(now)).alias("compacted")))
        # One file an hour, so an hour's manifest appears whole or not at all.
        (manifest.repartition("signal", "hour").write.mode("append").partitionBy("signal", "hour").parquet(f"{self.root}/manifests"))
        return number.join(counts, "hour", "left").select(F.lit(signal).alias("signal"), "hour", "n", F.coalesce("records", F.lit(0)).alias("records"))

    def prune_plan(self, signal: str, hours: Sequence[dt.datetime], now: dt.datetime, keep: dt.timedelta, purge: set[str] = frozenset()) -> DataFrame:
        """``path`` of what a trusted manifest older than ``keep`` makes redundant: covered batches and superseded
        manifests by file (a batch may land in their folder at any time), superseded parts by folder."""
        names = [hour_text(h) for h in hours]
        m = self.manifests(signal, names)
        ready = (m.groupBy("hour").agg(F.max("n").alias("latest"), F.max_by("compacted", "n").alias("compacted"))
                 .filter((F.col("compacted") <= F.lit(utc(now - keep))) | F.col("hour").isin(*purge or {""})))
        covered = m.join(ready, "hour").filter("n = latest").select(F.concat(F.lit(f"{self.root}/"), "batch").alias("path"))
        held = [f"{self.root}/compacted/signal={signal}/hour={h}" for h in names if self._exists(f"compacted/signal={signal}/hour={h}")]
        parts = list_files(self.spark, held, "*.parquet").select(F.regexp_extract("path", r"^(.*/n=\d+)/", 1).alias("path"), F.regexp_extract("path", r"/hour=([^/]+)/", 1).alias("hour"),
                                                                 F.regexp_extract("path", r"/n=(\d+)/", 1).cast("int").alias("n"))
        old_parts = parts.join(ready, "hour").filter("n <> latest").select("path")
        if self._exists(f"manifests/signal={signal}"):
            files = m.select("hour", "n", F.col("_metadata.file_path").alias("path")).distinct() if m.inputFiles() else None
        else:
            files = None
        out = covered.union(old_parts)
        if files is not None:
            out = out.union(files.join(ready, "hour").filter("n < latest").select("path"))
        return out.filter("path IS NOT NULL").distinct()

    def prune(self, signal: str, hours: Sequence[dt.datetime], now: dt.datetime, keep: dt.timedelta, purge: set[str] = frozenset()) -> int:
        """Delete what the plan names, streamed through the driver a partition at a time, ``DELETES`` at once."""
        n, paths = 0, (r.path for r in cut(self.prune_plan(signal, hours, now, keep, purge), "prune").toLocalIterator())
        with ThreadPoolExecutor(DELETES) as pool:
            while some := list(itertools.islice(paths, 64 * DELETES)):
                list(pool.map(self._delete, some))
                n += len(some)
        return n

    # --- retention ----------------------------------------------------------------------------
    def _bytes(self, folder: str) -> int:
        p = self._path(f"{self.root}/{folder}")
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0

    def _hours_held(self) -> set[str]:
        """Hours with batches or parts, from folder names."""
        out: set[str] = set()
        for s in cv.SIGNALS:
            out |= self._values(f"compacted/signal={s}", "hour=")
            for y in filter(str.isdigit, self._names(s)):
                for m in filter(str.isdigit, self._names(f"{s}/{y}")):
                    for d in filter(str.isdigit, self._names(f"{s}/{y}/{m}")):
                        out |= {f"{y}-{m}-{d}-{h}" for h in self._names(f"{s}/{y}/{m}/{d}") if h.isdigit()}
        return out

    def retain(self, now: dt.datetime, records: dt.timedelta | None = dt.timedelta(days=7), rolled: dt.timedelta | None = dt.timedelta(days=396),
               max_bytes: int | None = None) -> DataFrame:
        """Delete what is past its time: whole hours of batches, parts and manifests, days of the index, days
        and months of rollups; then, while the records left are over ``max_bytes`` (None or 0: no limit), their
        oldest hours. Folders go in one call each, so the work is of hours and days, not of files. Returns
        ``folder, bytes, reason``."""
        gone: list[tuple[str, int, str]] = []

        def drop(folder: str, reason: str) -> None:
            if self._exists(folder):
                gone.append((folder, self._bytes(folder), reason))
                self._delete(f"{self.root}/{folder}")

        def of(hour: str) -> list[str]:
            return [f for s in cv.SIGNALS for f in (f"{s}/{hour.replace('-', '/')}", f"compacted/signal={s}/hour={hour}", f"manifests/signal={s}/hour={hour}")]
        total = 0
        for hour in sorted(self._hours_held(), reverse=True):
            old = records is not None and dt.datetime.strptime(hour, HOUR) + dt.timedelta(hours=1) < now - records
            total += 0 if old else sum(map(self._bytes, of(hour)))
            for folder in of(hour) if old or 0 < (max_bytes or 0) < total else ():
                drop(folder, "age" if old else "size")
        for day in self._values("index/items", "day="):
            if records is not None and dt.datetime.fromisoformat(day) + dt.timedelta(days=1) < now - records:
                drop(f"index/items/day={day}", "age")
        for kind in ROLLUPS:
            for period in ("daily", "monthly"):
                for day in self._values(f"rollups/{kind}/{period}", "day="):
                    start = dt.date.fromisoformat(day)
                    end = start + dt.timedelta(days=1) if period == "daily" else rollups.next_month(start)
                    if rolled is not None and dt.datetime.combine(end, dt.time()) < now - rolled:
                        drop(f"rollups/{kind}/{period}/day={day}", "age")
        return self.spark.createDataFrame(gone, "folder string, bytes bigint, reason string")

    # --- item index ---------------------------------------------------------------------------
    def part_days(self, signals: Sequence[str]) -> set[dt.date]:
        return {dt.datetime.strptime(h, HOUR).date() for s in signals for h in self._values(f"compacted/signal={s}", "hour=")}

    def unindexed_days(self, days: set[dt.date]) -> set[dt.date]:
        """Days with parts but no index, after a crash between the two."""
        have = {dt.date.fromisoformat(d) for d in self._values("index/items", "day=")}
        return (self.part_days(cv.INDEXED_SIGNALS) & days) - have

    def build_item_index(self, days: Sequence[dt.date]) -> None:
        """Rewrite the item index of some days from their trusted parts, with one coverage row a part."""
        hours = [dt.datetime.combine(d, dt.time(h)) for d in days for h in range(24)]
        rows, cover = None, []
        for signal in cv.INDEXED_SIGNALS:
            parts = [s for s in self.state(signal, hours) if s.n]
            if not parts:
                continue
            base = f"{self.root}/compacted/signal={signal}"
            df = read_parts(self.spark, signal, [f"{base}/hour={s.hour}/n={s.n}" for s in parts], (), ["hour", "n"], base, check=False)
            one = item_index(df.withColumn("signal", F.lit(signal)).withColumn("hour", F.to_timestamp("hour", "yyyy-MM-dd-HH")))
            rows = one if rows is None else rows.unionByName(one)
            cover += [(utc(dt.datetime.strptime(s.hour, HOUR)), signal, s.n) for s in parts]
        if rows is None:
            return
        coverage = self.spark.createDataFrame(cover, "hour timestamp, signal string, manifest int")
        out = rows.unionByName(coverage, allowMissingColumns=True).withColumn("day", F.to_date("hour"))
        out = out.select(*ITEM_INDEX.fieldNames(), F.date_format("day", "yyyy-MM-dd").alias("day"))
        (out.hint("rebalance", "day").sortWithinPartitions("day", F.asc_nulls_first("item_key"), "hour").write.mode("overwrite")
         .option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.root}/index/items"))

    def item_hours(self, item: str, states: Sequence[HourState]) -> list[HourState]:
        """The hours an item's history must read: all but those the index covers, at their current
        number and with no batch beside them, and does not list the item in."""
        days = {s.hour[:10] for s in states} & self._values("index/items", "day=")
        if not days:
            return list(states)
        base = f"{self.root}/index/items"
        index = self.spark.read.schema(ITEM_INDEX).option("basePath", base).parquet(*[f"{base}/day={d}" for d in sorted(days)])
        found = (index.filter(F.col("item_key").isNull() | (F.col("item_key") == item))
                 .groupBy("signal", F.date_format("hour", "yyyy-MM-dd-HH").alias("hour"))
                 .agg(F.max("manifest").alias("n"), F.max(F.col("item_key").isNotNull()).alias("hit")).collect())
        at = {(r.signal, r.hour): r for r in found}
        late = self.batch_files([s for s in states if s.batches and s.n]).select("signal", "hour").distinct().collect()
        late = {(r.signal, r.hour) for r in late}

        def skip(s: HourState) -> bool:
            r = at.get((s.signal, s.hour))
            return bool(s.n and r and r.n == s.n and not r.hit and (s.signal, s.hour) not in late)
        return [s for s in states if not skip(s)]

    # --- rollups ------------------------------------------------------------------------------
    def rollup(self, kind: str, period: str) -> DataFrame:
        folder = f"rollups/{kind}/{period}"
        if not self._names(folder):
            return nothing(self.spark, ROLLUPS[kind])
        return self.spark.read.schema(ROLLUPS[kind]).parquet(f"{self.root}/{folder}")

    def rolled(self, kind: str, period: str) -> set[dt.date]:
        return {dt.date.fromisoformat(d) for d in self._values(f"rollups/{kind}/{period}", "day=")}

    def _write_rollup(self, df: DataFrame, kind: str, period: str) -> None:
        (df.hint("rebalance", "day").write.mode("overwrite").option("compression", "zstd")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.root}/rollups/{kind}/{period}"))

    def roll_days(self, days: Sequence[dt.date]) -> None:
        """Both rollups of some receipt days, all days in one job each. A day without rows still gets
        its folder, so it is known to be rolled."""
        for kind, signal in (("runs", "traces"), ("metrics", "metrics")):
            self._write_rollup(rollups.ROLL[kind](self.by_day(signal, days)).select(*ROLLUPS[kind].fieldNames()), kind, "daily")
            for d in set(days) - self.rolled(kind, "daily"):
                self._fs.mkdirs(self._path(f"{self.root}/rollups/{kind}/daily/day={d}"))

    def roll_months(self, months: Sequence[dt.date]) -> None:
        for kind in ("runs", "metrics"):
            daily = self.rollup(kind, "daily").filter(F.trunc("day", "month").isin(list(months)))
            self._write_rollup(rollups.ROLL_MONTH[kind](daily).select(*ROLLUPS[kind].fieldNames()), kind, "monthly")
            for m in set(months) - self.rolled(kind, "monthly"):
                self._fs.mkdirs(self._path(f"{self.root}/rollups/{kind}/monthly/day={m}"))

    def refresh_set(self, now: dt.datetime, touched: set[dt.date], lookback: dt.timedelta, grace: dt.timedelta) -> tuple[list, list]:
        """Closed days to roll (touched, or with parts and no rollup) and the closed months that hold them."""
        slack, d, days = dt.timedelta(hours=1) + grace, (now - lookback).date(), []
        have, parts = self.rolled("runs", "daily"), self.part_days(("traces", "metrics"))
        while dt.datetime.combine(d + dt.timedelta(days=1), dt.time()) + slack <= now:
            if d in touched or (d in parts and d not in have):
                days.append(d)
            d += dt.timedelta(days=1)
        months = sorted({rollups.month_start(x) for x in days
                         if dt.datetime.combine(rollups.next_month(x), dt.time()) + slack <= now})
        return days, months

    def refresh_rollups(self, now: dt.datetime, touched: set[dt.date], lookback: dt.timedelta = dt.timedelta(days=7),
                        grace: dt.timedelta = dt.timedelta(minutes=10)) -> None:
        days, months = self.refresh_set(now, touched, lookback, grace)
        if days:
            self.roll_days(days)
        if months:
            self.roll_months(months)

    def rollup_source(self, kind: str, since: dt.datetime, until: dt.datetime) -> DataFrame:
        """A long window's rollup rows: months, days, and days with no rollup answered from their records."""
        months, days = self.rolled(kind, "monthly"), self.rolled(kind, "daily")
        _, _, open_days = rollups.cover(since, until, months, days)
        signal = "traces" if kind == "runs" else "metrics"
        records = self.by_day(signal, open_days)
        return rollups.spliced(kind, self.rollup(kind, "monthly"), self.rollup(kind, "daily"), records, since, until, months, days)


def item_index(records: DataFrame) -> DataFrame:
    """``item_key, hour, signal, step_id, trace_id, first_seen, last_seen`` of records with ``hour, signal``."""
    return (records.filter(F.col("item_key").isNotNull()).groupBy("item_key", "hour", "signal", "step_id", "trace_id")
            .agg(F.min("time").alias("first_seen"), F.max("time").alias("last_seen")))
