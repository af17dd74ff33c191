import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from otlp import NOW, event, metric, run, ship, span
from tracehold import conventions as cv
from tracehold.plans.engine import Engine, parse_when
from tracehold.plans.store import Store
from tracehold.sources.batches import line_signal, line_status, unreadable_lines

H, D, M = (lambda n: dt.timedelta(hours=n)), (lambda n: dt.timedelta(days=n)), (lambda n: dt.timedelta(minutes=n))


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_named_queries(spark, tmp_path):
    root = str(tmp_path)
    at = NOW - H(3)
    a = run("a1", "1", "fix", "converged", "opus", 1.25, at, attributes={cv.ITEM_KEY: "I-1", cv.STEP_ID: "s1"})
    b = run("a2", "2", "fix", "budget", "opus", 2.5, at + M(5), attributes={cv.ITEM_KEY: "I-1", cv.STEP_ID: "s2"})
    c = run("a3", "3", "", "converged", "haiku", 0.25, at + M(9))
    for _ in range(2):
        ship(root, "traces", at + M(1), a, b)
    ship(root, "traces", at + M(1), c, "not json", '{"resourceSpans": 5}')
    ship(root, "traces", at - H(72), run("old", "9", "fix", "converged", "opus", 1.0, at))
    tree = "ff".rjust(32, "0")
    ship(root, "traces", at, span(tree, "a", "root", at, parent="zz"), span(tree, "b", "x", at + M(1), parent="a"),
         span(tree, "c", "y", at + M(2), parent="a"), span(tree, "d", "z", at + M(3), parent="c"), span("ee", "a", "o", at))
    ship(root, "logs", at, event("started", at - M(1), attributes={cv.ITEM_KEY: "I-1"}), event("other", at, attributes={cv.ITEM_KEY: "I-2"}),
         event("", at, attributes={cv.ITEM_KEY: "I-1"}))
    e = Engine(spark, root, now=NOW)
    assert rows(e.query("runs"), "lane", "outcome", "runs", "median_s", "cost_usd") == [
        ("(by hand)", "converged", 1, 90.0, 0.25), ("fix", "budget", 1, 90.0, 2.5), ("fix", "converged", 1, 90.0, 1.25)]
    assert rows(e.query("runs", lane="fix"), "outcome") == [("budget",), ("converged",)]
    assert rows(e.query("cost"), "model", "runs", "cost_usd", "input_tokens", "output_tokens") == [
        ("opus", 3, 4.75, 3000, 600), ("haiku", 1, 0.25, 1000, 200)]   # seven days back, the early batch's hour is read too
    assert [r[0].lstrip("0") for r in rows(e.query("recent"), "trace_id")] == ["a3", "a2", "a1"]
    assert rows(e.query("items"), "item", "steps", "traces", "last_outcome") == [("I-1", 2, 2, "budget")]
    assert rows(e.query("item", "I-1"), "record", "name") == [("event", "started"), ("span", cv.RUN_SPAN), ("span", cv.RUN_SPAN)]
    assert rows(e.query("trace", tree.upper()), "span_id", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert [r.name for r in e.names().collect()] == ["cost", "item", "items", "recent", "runs", "trace"]
    got = e.sql("SELECT count(*) AS n FROM spans WHERE name = :run AND time >= :since", NOW - H(9), NOW, run=cv.RUN_SPAN).first().n
    assert got == 3


def test_empty_store(spark, tmp_path):
    e = Engine(spark, str(tmp_path), now=NOW)
    for name, arg in [("runs", None), ("recent", None), ("items", None), ("item", "x"), ("trace", "x"), ("cost", None)]:
        assert e.query(name, arg).collect() == [], name
    assert e.query("cost", since="30d").collect() == [] and e.from_rollups


def test_arguments(spark, tmp_path):
    e = Engine(spark, str(tmp_path), now=NOW)
    for bad in [dict(name="item"), dict(name="runs", arg="x"), dict(name="runs", since="1h", until="2h"), dict(name="none"),
                dict(name="runs", since="8d", labels=["a:b"]), dict(name="runs", labels=["A:b"]), dict(name="runs", since="-1h")]:
        with pytest.raises(ValueError):
            e.query(**bad)
    assert parse_when("7d", NOW) == NOW - D(7) and parse_when("1h30m", NOW) == NOW - M(90)
    assert parse_when("2026-10-05T20:00:00+02:00", NOW) == NOW.replace(hour=18, minute=0)


def test_points(spark, tmp_path):
    root, at = str(tmp_path), NOW - H(2)
    for stamp in ("1", "2"):  # the receipt stamp differs between two deliveries of one record
        res = {cv.SERVICE_NAME: "s", cv.RECEIVED_AT: f"2026-10-05T19:0{stamp}:00.000Z"}
        ship(root, "metrics", at, metric("cost", 1, 1.5, at, resource=res), metric("lat", 2, 4.5, at, kind="histogram", resource=res),
             metric("g", 0, 2.0, at, kind="gauge", resource=res), metric("x", 2, 7.0, at, kind="exponentialHistogram", resource=res))
    got = rows(Store(spark, root).table("metrics", [at]).orderBy("name"), "name", "type", "temporality", "monotonic", "value", "count", "service")
    assert got == [("cost", "sum", "delta", True, 1.5, None, "s"), ("g", "gauge", None, None, 2.0, None, "s"),
                   ("lat", "histogram", "cumulative", None, 4.5, 3.0, "s"), ("x", "exponential_histogram", "cumulative", None, 7.0, 3.0, "s")]
    assert Store(spark, root, identity="raw").table("metrics", [at]).count() == 8


def test_lifecycle(spark, tmp_path):
    """Batches, compaction, a late batch, again: the same answer at every stage."""
    root, at = str(tmp_path), NOW - H(3)
    a, b = run("1", "1", "fix", "converged", "m", 1.0, at), run("2", "2", "fix", "converged", "m", 1.0, at)
    first = [ship(root, "traces", at, a, b), ship(root, "traces", at, a)]
    e = Engine(spark, root, now=NOW)
    total = lambda: sum(r.runs for r in e.query("runs").collect())
    assert total() == 2
    done = e.store.compact(NOW, keep=H(1)).collect()
    assert [(r.signal, r.n, r.records) for r in done] == [("traces", 1, 2)] and total() == 2
    assert all(os.path.exists(p) for p in first)
    late = ship(root, "traces", at, b, run("3", "3", "fix", "budget", "m", 1.0, at))
    assert total() == 3
    plan = e.store.read_plan(["traces"], NOW - H(5), NOW).collect()
    assert sorted((r.kind, r.path.split("/")[-1]) for r in plan) == [("batch", os.path.basename(late)), ("part", "n=1")]
    assert [(r.n, r.records) for r in e.store.compact(NOW + M(5)).collect()] == [(2, 3)] and total() == 3
    assert e.store.compact(NOW + M(5)).collect() == []
    e2 = Engine(spark, root, now=NOW + H(2))
    e2.store.compact(NOW + H(2))
    assert not any(os.path.exists(p) for p in [*first, late])
    assert len(glob.glob(f"{root}/compacted/signal=traces/hour=*/n=*/*.parquet")) == 1
    assert glob.glob(f"{root}/compacted/signal=traces/hour=*/n=1/*.parquet") == []
    assert total() == 3
    part = spark.read.parquet(f"{root}/compacted/signal=traces")
    assert [r.file for r in part.select("file").distinct().collect()][0].endswith("/n=2")


def test_manifest_outside_its_hour(spark, tmp_path):
    root, at = str(tmp_path), NOW - H(3)
    ship(root, "traces", at, run("1", "1", "fix", "converged", "m", 1.0, at))
    s = Store(spark, root)
    s.compact(NOW)
    m = spark.read.parquet(f"{root}/manifests").withColumn("n", F.lit(9)).withColumn("part", F.lit("compacted/signal=traces/hour=x/n=9"))
    m.write.mode("append").partitionBy("signal", "hour").parquet(f"{root}/manifests")
    with pytest.raises(ValueError, match="outside its hour"):
        s.table("traces", [at])


def test_item_index(spark, tmp_path):
    root = str(tmp_path)
    day = NOW.replace(hour=0, minute=0) + H(8)
    for i in range(5):
        at = day + H(i)
        ship(root, "traces", at, run(f"{i}", f"{i}", "fix", "converged", "m", 1.0, at, attributes={cv.ITEM_KEY: "I-1" if i == 2 else "I-9"}))
    s = Store(spark, root)
    s.compact(NOW)
    hours = [day + H(i) for i in range(5)]
    st = s.state("traces", hours)
    assert len(st) == 5 and [x.hour[-2:] for x in s.item_hours("I-1", st)] == ["10"] and s.item_hours("none", st) == []
    ship(root, "traces", day, run("9", "9", "fix", "converged", "m", 1.0, day, attributes={cv.ITEM_KEY: "I-1"}))
    assert sorted(x.hour[-2:] for x in s.item_hours("I-1", s.state("traces", hours))) == ["08", "10"]
    assert len(Engine(spark, root, now=NOW).query("item", "I-1").collect()) == 2
    cover = spark.read.parquet(f"{root}/index/items").filter("item_key IS NULL")
    assert cover.count() == 5 and {r.manifest for r in cover.collect()} == {1}


def test_long_windows(spark, tmp_path):
    """A year of cost from months, days and an open day, each day once; parts gone, answers stay."""
    root = str(tmp_path)
    times = [dt.datetime(2026, 8, 10, 10), dt.datetime(2026, 9, 3, 10), dt.datetime(2026, 9, 4, 11), dt.datetime(2026, 10, 2, 9)]
    for i, at in enumerate(times):
        ship(root, "traces", at, run(f"{i}", f"{i}", "fix", "converged", "m", 1.5, at))
    for at, v in [(times[1], 1.0), (times[2], 2.0)]:
        ship(root, "metrics", at, metric("d", 1, v, at), metric("c", 2, v + 1, at, kind="sum"))
    s = Store(spark, root)
    s.compact(NOW, lookback=D(90))
    e = Engine(spark, root, now=NOW)
    ask = lambda: rows(e.query("cost", since="365d"), "model", "runs", "cost_usd", "input_tokens", "output_tokens")
    assert ask() == [("m", 4, 6.0, 4000, 800)] and e.from_rollups
    sept = s.rollup("metrics", "monthly").filter("day = date'2026-09-01'").orderBy("name")
    assert rows(sept, "name", "total") == [("c", 3.0), ("d", 3.0)]
    ship(root, "traces", NOW - H(1), run("7", "7", "fix", "budget", "m", 2.0, NOW - H(1)))   # the open day
    ship(root, "traces", dt.datetime(2026, 9, 20, 5), run("8", "8", "fix", "budget", "m", 4.0, dt.datetime(2026, 9, 20, 5)))  # in a rolled month
    assert ask() == [("m", 5, 8.0, 5000, 1000)]
    assert rows(e.query("runs", since="365d"), "outcome", "runs", "median_s") == [("converged", 4, None), ("budget", 1, None)]
    s.compact(NOW, lookback=D(90))
    assert ask() == [("m", 6, 12.0, 6000, 1200)]


def test_labels_and_erasure(spark, tmp_path):
    root, at, p = str(tmp_path), NOW - H(3), cv.LABEL_PREFIX
    lab = lambda n, who, **kv: run(n, n, "fix", "converged", "m", 1.0, at, resource={p + k: v for k, v in kv.items()}, attributes={cv.USER_NAME: who})
    ship(root, "traces", at, lab("1", "alice", team="a", colour="red"), lab("2", "bob", team="a"), lab("3", "bob", team="b"))
    e = Engine(spark, root, now=NOW)
    ids = lambda *labels: sorted(r.trace_id[-1] for r in e.query("recent", labels=labels).collect())
    assert ids("team:a") == ["1", "2"] and ids("team:a", "colour:red") == ["1"] and ids("team:b", "colour:blue") == []
    e.store.compact(NOW, keep=D(9))
    e = Engine(spark, root, erased=["bob"], now=NOW)
    assert sorted(rows(e.query("recent"), "actor")) == [("(erased)",), ("(erased)",), ("alice",)]
    assert e.store.hours_holding("traces", [at]) == {(at).strftime("%Y-%m-%d-%H")}
    e.store.compact(NOW, keep=D(9))
    assert e.store.hours_holding("traces", [at]) == set()
    text = b"".join(open(f, "rb").read() for f in glob.glob(f"{root}/compacted/**/*.parquet", recursive=True))
    assert b"bob" not in text and glob.glob(f"{root}/traces/**/*.gz", recursive=True) == []


def test_damaged_batch_and_old_schema(spark, tmp_path):
    root, at = str(tmp_path), NOW - H(3)
    ship(root, "traces", at, run("1", "1", "fix", "converged", "m", 1.0, at))
    ship(root, "traces", at, raw=b"this is not gzip")
    s = Store(spark, root)
    assert s.table("traces", [at]).count() == 1
    s.compact(NOW)
    # A part of the first version: no version column, no labels.
    base = f"{root}/compacted/signal=traces"
    old = at - H(1)
    (spark.read.parquet(base).drop("labels", "_schema_version", "n").withColumn("n", F.lit(1)).withColumn("hour", F.lit(old.strftime("%Y-%m-%d-%H")))
     .withColumn("record_id", F.lit("old")).write.mode("append").partitionBy("hour", "n").parquet(base))
    m = spark.createDataFrame([("traces", old.strftime("%Y-%m-%d-%H"), 1, f"compacted/signal=traces/hour={old:%Y-%m-%d-%H}/n=1", "b", 1, NOW)],
                              "signal string, hour string, n int, part string, batch string, records bigint, compacted timestamp")
    m.write.mode("append").partitionBy("signal", "hour").parquet(f"{root}/manifests")
    got = {r.record_id: r.labels for r in s.table("traces", [old, at]).collect()}
    assert len(got) == 2 and got["old"] is None
    bad = spark.read.parquet(base).withColumn("_schema_version", F.lit("3"))
    from tracehold.sources.parts import NewerSchema, check_version
    with pytest.raises(NewerSchema):
        check_version(bad)


def test_damaged_batches_are_kept_aside(spark, tmp_path):
    """A truncated batch is neither covered nor deleted; lines that hold no record are written down."""
    root, at = str(tmp_path), NOW - H(5)
    ship(root, "traces", at, run("a1", "1", "fix", "converged", "opus", 1.0, at), "not json")
    ship(root, "traces", at, *[run(f"b{i}", f"{i}", "fix", "budget", "opus", 1.0, at) for i in range(200)])
    good, bad = sorted(glob.glob(f"{root}/traces/**/*.gz", recursive=True), key=os.path.getsize)
    data = open(bad, "rb").read()
    open(bad, "wb").write(data[:len(data) // 2])
    e = Engine(spark, root, now=NOW)
    e.store.compact(NOW)
    e.store.compact(NOW + H(2))
    key = os.path.relpath(bad, root)
    assert open(f"{root}/quarantine/files/{key}", "rb").read() == data[:len(data) // 2]
    assert not os.path.exists(bad) and not os.path.exists(good)
    assert rows(e.query("runs"), "outcome", "runs") == [("converged", 1)]
    assert sorted((r.kind, r.path.rsplit("/", 1)[-1], r.lines) for r in e.store.quarantined().collect()) == [
        ("damaged", os.path.basename(bad), None), ("malformed", os.path.basename(good), 1)]
    assert [r.line for r in spark.read.parquet(f"{root}/quarantine/lines").collect()] == ["not json"]
    os.makedirs(os.path.dirname(bad), exist_ok=True)  # sent again, whole
    open(bad, "wb").write(data)
    e.store.compact(NOW + H(3))
    assert sorted(rows(e.query("runs"), "outcome", "runs")) == [("budget", 200), ("converged", 1)]


def test_answers_find_candidates_first(spark, tmp_path):
    """Filters reach the scan of the narrow pass, and a copy that differs is judged by the copy that counts."""
    root, at = str(tmp_path), NOW - H(5)
    ship(root, "traces", at, run("a1", "1", "fix", "converged", "opus", 1.0, at), span("cc", "d", "step", at))
    e = Engine(spark, root, now=NOW)
    e.store.compact(NOW)
    plan = e.query("cost")._jdf.queryExecution().executedPlan().toString()
    narrow = [x for x in plan.split("\n") if "FileScan parquet" in x and "EqualTo(name," in x]
    assert narrow and all("attributes" not in x.split("ReadSchema")[1] for x in narrow)
    assert rows(e.query("cost"), "model", "runs") == [("opus", 1)]


def test_retention_over_the_store_s_own_layout(spark, tmp_path):
    from tracehold.sources.keys import key_span, parse_key
    root, at = str(tmp_path), NOW - H(5)
    ship(root, "traces", at, run("a1", "1", "fix", "converged", "opus", 1.0, at, attributes={cv.ITEM_KEY: "I-1"}))
    ship(root, "traces", at - D(9), run("old", "9", "fix", "converged", "opus", 1.0, at - D(9), attributes={cv.ITEM_KEY: "I-1"}))
    e = Engine(spark, root, now=NOW)
    e.store.compact(NOW, lookback=D(12), keep=H(0))
    files = [os.path.relpath(f, root) for f in glob.glob(f"{root}/**/*.parquet", recursive=True)]
    kinds = {r.k: r.kind for r in spark.createDataFrame([(f,) for f in files], "k string").select("k", parse_key(F.col("k"))["kind"].alias("kind"), key_span(F.col("k"))["start"].alias("s")).collect()}
    assert {(k.split("/")[0], v) for k, v in kinds.items() if v != "ignored"} >= {("compacted", "compacted"), ("index", "index"), ("rollups", "daily")}
    assert all(k.startswith("manifests/") for k, v in kinds.items() if v == "ignored")
    gone = rows(e.store.retain(NOW), "folder", "reason")
    hour = (at - D(9)).strftime("%Y-%m-%d-%H")
    assert {f for f, _ in gone} >= {f"compacted/signal=traces/hour={hour}", f"manifests/signal=traces/hour={hour}", f"index/items/day={hour[:10]}"} and {r for _, r in gone} == {"age"}
    assert not any("rollups" in f for f, _ in gone)
    assert rows(e.query("recent", since=NOW - D(20)), "trace_id") == [("a1".rjust(32, "0"),)]
    assert {r for _, r in rows(e.store.retain(NOW, max_bytes=1), "folder", "reason")} == {"size"}
    assert e.query("recent", since=NOW - D(20)).count() == 0


def test_a_moved_root(spark, tmp_path):
    """Manifests name batches under the root: a store copied elsewhere covers the same ones, and so does one
    whose manifests still hold whole paths."""
    import shutil
    root, moved, at = str(tmp_path / "a"), str(tmp_path / "b"), NOW - H(5)
    ship(root, "traces", at, run("1", "1", "fix", "converged", "m", 1.0, at), "not json")
    Store(spark, root).compact(NOW, keep=D(9))
    shutil.copytree(root, moved)
    for where in (moved, f"file://{moved}", f"file:{moved}/"):
        s = Store(spark, where)
        assert s.batch_files(s.state("traces", [at])).count() == 0 and s.table("traces", [at]).count() == 1
        assert s.compact(NOW).collect() == []
    m = spark.read.parquet(f"{root}/manifests")
    assert [r.batch.split("/")[0] for r in m.collect()] == ["traces"]
    old = m.withColumn("batch", F.concat(F.lit(f"file://{root}/"), "batch")).withColumns({"n": F.col("n") + 1, "part": F.regexp_replace("part", "n=1", "n=2")})
    spark.read.parquet(f"{root}/compacted/signal=traces/hour={at:%Y-%m-%d-%H}/n=1").write.parquet(f"{root}/compacted/signal=traces/hour={at:%Y-%m-%d-%H}/n=2")
    old.write.mode("append").partitionBy("signal", "hour").parquet(f"{root}/manifests")
    s = Store(spark, root)
    assert s.batch_files(s.state("traces", [at])).count() == 0
    assert s.prune("traces", [at], NOW + D(20), D(1)) == 3  # the batch, the first part's folder, its manifest
    assert glob.glob(f"{root}/traces/**/*.gz", recursive=True) == [] and os.listdir(f"{root}/compacted/signal=traces/hour={at:%Y-%m-%d-%H}") == ["n=2"]
    assert s.table("traces", [at]).count() == 1


def test_covered_batches_are_not_opened(spark, tmp_path, monkeypatch):
    """Beside a part only batches it does not cover are read, left out by name or, where many are covered, by a join."""
    root, at = str(tmp_path), NOW - H(3)
    first = ship(root, "traces", at, run("1", "1", "fix", "converged", "m", 1.0, at), run("2", "2", "fix", "converged", "m", 1.0, at))
    e = Engine(spark, root, now=NOW)
    e.store.compact(NOW, lookback=H(8))
    ship(root, "traces", at, run("2", "2", "fix", "converged", "m", 1.0, at), run("3", "3", "fix", "converged", "m", 1.0, at))
    copies = lambda: sorted(r.trace_id[-1] for r in e.store.copies("traces", e.store.state("traces", [at]), strict=True).collect())
    assert copies() == ["1", "2", "2", "3"]
    monkeypatch.setattr("tracehold.plans.store.BY_NAME", 0)
    assert copies() == ["1", "2", "2", "3"]
    monkeypatch.undo()
    with open(first, "wb") as f:
        f.write(b"junk")
    assert copies() == ["1", "2", "2", "3"]


def test_lines_without_records(spark, tmp_path):
    """Each line's status is the reader's, whatever the line holds."""
    good, log = run("1", "1", "fix", "converged", "m", 1.0, NOW), event("x", NOW)
    lines = [good, log, good + " ", good[:-1], "", " \t", "\v", "[]", "null", "{}", '{"resourceSpans":null}', '{"resourceSpans":[],"resourceLogs":[]}', '{"resourceSpans":5}', "x" * 5000, '"' + "y" * 5000]
    path = ship(str(tmp_path), "traces", NOW, *lines)
    want = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.when((line_status(F.col("line"), 4000) == "ok") & (line_signal(F.col("line")) != "traces"), "malformed")
                                                                              .otherwise(line_status(F.col("line"), 4000)).alias("status")).filter("status IN ('malformed', 'oversized')")
    got = unreadable_lines(spark, "traces", [os.path.dirname(path)], 4000)
    assert sorted(rows(got, "line", "status")) == sorted(rows(want, "line", "status")) and got.count() > 5


def test_quarantine_again(spark, tmp_path, monkeypatch):
    """A compaction that fails after the bad lines were written writes none of them twice."""
    root, at = str(tmp_path), NOW - H(5)
    ship(root, "traces", at, run("1", "1", "fix", "converged", "m", 1.0, at), "not json", "not json")
    s = Store(spark, root)
    with monkeypatch.context() as m:
        m.setattr(Store, "_compact_signal", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.compact(NOW)
    s.compact(NOW)
    assert [(r.kind, r.lines) for r in s.quarantined().collect()] == [("malformed", 2)]


def test_what_an_answer_rests_on(spark, tmp_path):
    import json
    root, at = str(tmp_path), NOW - H(5)
    ship(root, "traces", at, run("1", "1", "fix", "converged", "m", 1.0, at))
    e = Engine(spark, root, now=NOW)
    e.store.compact(NOW)
    ship(root, "traces", NOW - H(1), run("2", "2", "fix", "converged", "m", 1.0, NOW - H(1)))
    meta = json.loads(e.describe(e.query("runs", since="8h", lane="fix"), "runs", lane="fix").first().value)
    assert meta["since"] == str(NOW - H(8)) and meta["until"] == str(NOW) and meta["lane"] == "fix" and meta["damaged"] == 0
    assert (meta["batches"], meta["parts"], meta["from_rollups"]) == (1, 1, False) and "runs" in meta["columns"]
    meta = json.loads(e.describe(e.query("cost", since="30d"), "cost").first().value)
    assert meta["from_rollups"] is True and "parts" not in meta
    assert e.store.retain(NOW + H(1)).collect() == []  # nothing is past its time, and no size is set
