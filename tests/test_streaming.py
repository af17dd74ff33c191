import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F

from otlp import NOW, event, metric, run, ship, span
from tracehold import conventions as cv
from tracehold.plans.engine import Engine
from tracehold.plans.store import Store
from tracehold.sources import dims
from tracehold.sources.spool import counters, read_spool
from tracehold.streaming import hot, live
from tracehold.streaming.ship import ship_stream, shipped, write_batch

H = lambda n: dt.timedelta(hours=n)


def put(root, rel, *lines, end="\n"):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write("\n".join(lines) + end)
    return p


def spool_of(tmp_path):
    spool = str(tmp_path / "spool")
    put(spool, "runs/r1/a.jsonl", run("1", "1", "forged", "converged", "m", 1.0, NOW), "", "not json")
    put(spool, "runs/r1/b.open.jsonl", run("2", "2", "", "converged", "m", 1.0, NOW))
    put(spool, "services/svc/a.jsonl", event("started", NOW, {cv.SERVICE_NAME: "svc"}), metric("c", 1, 2.0, NOW) + "\r")
    put(spool, "local/x.jsonl", "x" * 300, run("3", "3", "", "budget", "m", 1.0, NOW))
    put(spool, "odd/x.jsonl", run("4", "4", "", "budget", "m", 1.0, NOW))
    put(spool, "manifests/r1.json", json.dumps({"run": "r1", "lane": "fix", "item": "I-1"}))
    return spool


def test_spool_and_ship(spark, tmp_path):
    spool, root = spool_of(tmp_path), str(tmp_path / "store")
    lines = read_spool(spark, spool, max_line=2000)
    assert counters(lines).first().asDict() == {"lines": 4, "malformed": 2, "oversized": 0, "blank": 1, "ignored": 1}
    assert counters(read_spool(spark, spool, max_line=299)).first().oversized >= 1
    src = {r.source for r in lines.filter("status = 'ok'").collect()}
    assert src == {"runs.r1.a", "services.svc.a", "local.x"}
    manifests = dims.read_run_manifests(spark, spool + "/manifests")
    for _ in range(2):  # the second start finds nothing new
        ship_stream(spark, spool, root, manifests, "pool1", str(tmp_path / "ck"), every=None).awaitTermination(120)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    s = Store(spark, root)
    hours = [now - H(1), now]
    got = {r.trace_id[-1]: (r.lane, r.item_key, r.provenance, r.collector_id) for r in s.table("traces", hours).collect()}
    assert got == {"1": ("fix", "I-1", "run", "pool1"), "3": (None, None, "local", "pool1")}
    assert s.table("logs", hours).count() == 1 and s.table("metrics", hours).count() == 1
    assert glob.glob(root + "/.staging/*") == []


def test_budget_and_marks_over_several_triggers(spark, tmp_path):
    """A run's bytes count over all batches, in order of file and place; a repeated batch counts once."""
    spool, root, ck = str(tmp_path / "spool"), str(tmp_path / "store"), str(tmp_path / "ck")
    line = lambda i: run(str(i), str(i), "", "converged", "m", 1.0, NOW)
    size = len(line(1)) + 1
    put(spool, "manifests/r1.json", json.dumps({"run": "r1", "lane": "fix", "item": "I-1"}))
    manifests = dims.read_run_manifests(spark, spool + "/manifests").withColumn("budget", F.lit(3 * size).cast("bigint"))
    registry = spark.createDataFrame([("other", "1")], "tool string, version string")
    go = lambda: ship_stream(spark, spool, root, manifests, "pool1", ck, every=None, registry=registry).awaitTermination(120)
    put(spool, "runs/r1/a.jsonl", line(1), line(2), "not json")
    put(spool, "services/svc/a.jsonl", *[event("started", NOW, {cv.SERVICE_NAME: "svc"}) for _ in range(9)])
    go()
    put(spool, "runs/r1/b.jsonl", line(3), line(4), line(5))
    go()
    put(spool, "runs/r1/c.jsonl", line(6))
    go()
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    s = Store(spark, root)
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl.gz").text(root)
    warned = {r.t[-1]: cv.OVER_BUDGET in r.value for r in raw.filter("value LIKE '%resourceSpans%'").select("value", F.regexp_extract("value", r'"traceId":"(\w+)"', 1).alias("t")).collect()}
    assert warned == {"1": False, "2": False, "3": True}
    assert raw.filter(F.col("value").contains(cv.REGISTRY_MARK)).count() == raw.count() > 3
    assert {r.trace_id[-1] for r in s.table("traces", [now - H(1), now]).collect()} == {"1", "2", "3"}
    want = {"lines": 15, "malformed": 1, "oversized": 0, "blank": 0, "ignored": 0, "over_budget": 3}
    assert shipped(spark, ck + "-ledger").first().asDict() == want
    again = read_spool(spark, spool).filter(F.col("rel").endswith("c.jsonl"))
    write_batch(again, manifests, root, "pool1", "b2", registry=registry, ledger=ck + "-ledger")
    assert shipped(spark, ck + "-ledger").first().asDict() == want


def test_lines_of_no_run_stay_in_their_pieces(spark, tmp_path):
    """Lines that no run wrote are not brought together for the manifests' sake; those of runs have their manifest."""
    spool, root = spool_of(tmp_path), str(tmp_path / "store")
    manifests = dims.read_run_manifests(spark, spool + "/manifests")
    each = [("service", "svc", run(str(i), str(i), "forged", "converged", "m", 1.0, NOW)) for i in range(400)]
    lines = spark.createDataFrame([(*x, "ok", "traces") for x in each], "class string, name string, line string, status string, signal string").repartition(4)
    assert len(write_batch(lines, manifests, root, "c1", "b0", received=NOW)) == 4
    mixed = spark.createDataFrame([(*x, "ok", "traces") for x in [("run", "r1", each[0][2]), ("run", "r2", each[1][2]), (None, None, each[2][2]), each[3]]], lines.schema)
    write_batch(mixed, manifests, root + "2", "c1", "b1", received=NOW)
    got = {r.trace_id[-1]: (r.lane, r.item_key, r.provenance) for r in Store(spark, root + "2").table("traces", [NOW]).collect()}
    assert got == {"0": ("fix", "I-1", "run"), "1": (None, None, "run"), "2": ("forged", None, None), "3": ("forged", None, "service")}


def test_a_fill_writes_an_hour_once(spark, tmp_path):
    """Each event hour of a filled table is one task's files, not every task's."""
    root, path = str(tmp_path / "store"), str(tmp_path / "hot")
    ship(root, "traces", NOW - H(1), *[run(str(i), str(i), "fix", "converged", "m", 1.0, NOW - H(1 + i % 3)) for i in range(300)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot.fill(Store(spark, root), path, "traces", H(6), NOW)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(len(glob.glob(f"{h}/*.parquet")) for h in glob.glob(f"{path}/spans/hour=*")) == [1, 1, 1]
    assert hot.hot_table(spark, path, "traces").count() == 300


def test_tail(spark, tmp_path):
    spool = spool_of(tmp_path)
    manifests = dims.read_run_manifests(spark, spool + "/manifests")
    q = live.tail(spark, spool, manifests).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.kind, r.name, r.lane, r.item, r.writer) for r in spark.table("tail").select("kind", "name", F.coalesce("lane", F.lit("")).alias("lane"), F.coalesce("item", F.lit("")).alias("item"), "writer").collect())
    assert got == [("event", "started", "", "", "services/svc"), ("metric", "c", "", "", "services/svc"),
                   ("span", cv.RUN_SPAN, "", "", "local"), ("span", cv.RUN_SPAN, "fix", "I-1", "runs/r1")]
    assert live.tail(spark, spool, manifests, item="I-1", streaming=False).count() == 1
    assert live.tail(spark, spool, manifests, service="svc", streaming=False).count() == 1


def test_hot(spark, tmp_path):
    root, path = str(tmp_path / "store"), str(tmp_path / "hot")
    old, at = NOW - H(9), NOW - H(2)
    a = run("1", "1", "fix", "converged", "m", 1.0, at)
    ship(root, "traces", at, a, run("0", "0", "fix", "converged", "m", 1.0, old))
    ship(root, "traces", at, raw=b"junk")
    sync = lambda exact=True, name="ck": hot.hot_stream(spark, root, path if exact else path + "w", "traces", H(6), str(tmp_path / name), exact, now=NOW, every=None, store=Store(spark, root) if exact else None).awaitTermination(120)
    unfilled = hot.Hot(Engine(spark, root, now=NOW), path, H(6))
    assert sum(r.runs for r in unfilled.query("runs", since="5h").collect()) == 1 and unfilled.from_store
    os.remove(glob.glob(f"{root}/traces/**/*.jsonl.gz", recursive=True)[-1])  # the damaged batch: a fill reads strictly
    sync()
    ship(root, "traces", at, a, run("2", "2", "fix", "budget", "m", 1.0, at))   # a copy and a new one
    sync()
    assert hot.hot_table(spark, path, "traces").count() == 2
    e = Engine(spark, root, now=NOW)
    h = hot.Hot(e, path, H(6))
    assert sum(r.runs for r in h.query("runs", since="5h").collect()) == 2 and not h.from_store
    assert h.query("runs", since="12h").count() and h.from_store
    later = NOW + H(5)
    assert hot.evict_hot(spark, path, later, H(6)) == 1
    sync(exact=False, name="ck2")
    assert hot.hot_table(spark, path + "w", "traces").count() == 3   # one copy of each; old rows are not late in a first batch


def test_hot_from_parts(spark, tmp_path):
    """Batches that were compacted and pruned, a batch beside the part, and runs of the stream apart: the hot
    tables answer as the store does, and nothing is held twice."""
    root, path, at = str(tmp_path / "store"), str(tmp_path / "hot"), NOW - H(3)
    for i in range(4):
        ship(root, "traces", at, run(str(i), str(i), "fix", "converged", "m", 1.0, at), run("9", "9", "fix", "budget", "m", 1.0, at))
    ship(root, "traces", at, run("old", "a", "fix", "converged", "m", 1.0, NOW - H(20)))
    e = Engine(spark, root, now=NOW)
    e.store.compact(NOW, keep=H(0), lookback=H(8))
    e.store.compact(NOW + H(1), keep=H(0), lookback=H(8))
    assert not glob.glob(f"{root}/traces/**/*.jsonl.gz", recursive=True)
    ship(root, "traces", at, run("5", "5", "fix", "converged", "m", 1.0, at), run("0", "0", "fix", "converged", "m", 1.0, at))
    sync = lambda: hot.hot_stream(spark, root, path, "traces", H(6), str(tmp_path / "ck"), now=NOW, every=None, store=e.store).awaitTermination(120)
    both = lambda name: [sorted(map(tuple, q.query(name, since="5h").collect()), key=str) for q in (hot.Hot(e, path, H(6)), e)]
    sync()
    h = hot.Hot(e, path, H(6))
    assert sum(r.runs for r in h.query("runs", since="5h").collect()) == 6 and not h.from_store
    for name in ("runs", "recent", "cost"):
        got, want = both(name)
        assert got == want
    ship(root, "traces", NOW - H(1), run("6", "6", "fix", "converged", "m", 1.0, NOW - H(1)))
    e.store.compact(NOW, keep=H(0), lookback=H(8))  # while no stream runs
    sync()
    sync()
    assert hot.hot_table(spark, path, "traces").count() == 7
    h.query("item", "x", since="5h")
    assert h.from_store  # the logs have not been filled


def test_counts_and_crashes(spark, tmp_path):
    src = str(tmp_path / "in")
    spans = spark.createDataFrame([(cv.RUN_SPAN, "fix", "converged", NOW), (cv.RUN_SPAN, None, None, NOW), ("x", "fix", "a", NOW)],
                                  "name string, lane string, outcome string, time timestamp")
    spans.write.parquet(src)
    q = (live.run_counts(spark.readStream.schema(spans.schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("counts")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sorted((r.lane, r.outcome, r.runs) for r in spark.table("counts").collect()) == [("(by hand)", "(none)", 1), ("fix", "converged", 1)]

    marks = str(tmp_path / "marks")
    schema = "trace_id string, unit string, what string, time timestamp"
    def add(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(marks)
    add(("t1", "u", "start", NOW), ("t2", "u", "start", NOW), ("t2", "u", "span", NOW))
    run_once = lambda: (live.unfinished_stream(spark.readStream.schema(schema).parquet(marks), "1 hour").writeStream.format("parquet")
                        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120))
    run_once()
    add(("t3", "u", "start", NOW + H(3)))
    run_once()
    add(("t4", "u", "start", NOW + H(3)))
    run_once()
    assert [(r.trace_id, r.unit) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("t1", "u")]


def test_unfinished_units(spark, tmp_path):
    """Copies, null units, ends that come first or late, and a stream in which nothing ever ends."""
    schema = "trace_id string, unit string, what string, time timestamp"

    def unfinished(name, *deliveries):
        src, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
        for rows in deliveries:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            (live.unfinished_stream(spark.readStream.schema(schema).parquet(src), "1 hour").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start().awaitTermination(120))
        return sorted((r.trace_id, r.unit, r.started) for r in spark.read.schema("trace_id string, unit string, started timestamp").parquet(out).collect())
    after = [("z", "u", "start", NOW + H(30))]
    assert unfinished("alone", [("a", "u", "start", NOW), ("a", "u", "start", NOW), ("b", None, "start", NOW)], after) == [("a", "u", NOW), ("b", None, NOW)]
    early = [("a", "u", "span", NOW + H(0.1)), ("b", None, "start", NOW), ("c", "u", "start", NOW), ("d", "u", "start", NOW), ("e", "v", "span", NOW)]
    late = [("a", "u", "start", NOW), ("b", None, "span", NOW + H(0.99)), ("c", "u", "span", NOW + H(1.01)), ("d", "w", "span", NOW), ("d", "u", "span", NOW)]
    assert unfinished("mixed", early, late + late, after) == [("c", "u", NOW)]


def test_spool_under_a_uri(spark, tmp_path):
    """However its root is spelled, a spool's lines are told apart the same way."""
    spool = spool_of(tmp_path)
    one = lambda root: sorted((r.rel, r.status) for r in read_spool(spark, root).select("rel", "status").collect())
    want = one(spool)
    assert any(s == "ok" for _, s in want)
    for root in (f"file://{spool}", f"file:{spool}/", f"{spool}/"):
        assert one(root) == want
