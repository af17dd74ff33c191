import datetime as dt

from tracehold.operators.dedupe import combined, new_records, one_per_record
from tracehold.operators.forest import ancestry
from tracehold.operators.prefix import running_total
from pyspark.sql import functions as F

T0 = dt.datetime(2026, 1, 1)


def test_depths_orphans_cycles_and_the_limit(spark):
    chain = [("t", f"c{i}", f"c{i-1}" if i else None) for i in range(70)]
    rows = chain + [("t", "o", "missing"), ("t", "oc", "o"), ("t", "x", "y"), ("t", "y", "x"), ("t", "z", "x"), ("t", "self", "self"), ("u", "c1", "c0")]
    df = spark.createDataFrame([(t, s, p, T0 + dt.timedelta(seconds=i)) for i, (t, s, p) in enumerate(rows)],
                               "trace_id string, span_id string, parent_span_id string, time timestamp")
    for limit, deepest in ((None, 69), (64, 64)):
        got = {(r.trace_id, r.span_id): (r.depth, r.root_span_id, len(r.path)) for r in ancestry(df, limit).collect()}
        want = {("t", f"c{i}"): (i, "c0", i + 1) for i in range(deepest + 1)}
        want |= {("t", "o"): (0, "o", 1), ("t", "oc"): (1, "o", 2), ("u", "c1"): (0, "c1", 1)}
        assert got == want


def test_copies(spark):
    df = spark.createDataFrame([("a", "f2", 1), ("a", "f1", 2), (None, "f1", 3), (None, "f2", 4), ("b", None, 5)], "record_id string, file string, v int")
    assert sorted(r.v for r in one_per_record(df).collect()) == [2, 3, 5]
    assert sorted(r.v for r in one_per_record(df, "content_hash").collect()) == [2, 3, 4, 5]
    part = spark.createDataFrame([("a", "compacted/x")], "record_id string, file string")
    assert sorted((r.file or "") for r in combined(df, part).collect()) == ["", "compacted/x", "f1"]
    assert sorted(r.v for r in new_records(df, part).collect()) == [3, 4, 5]


def test_duplicates_and_order_change_nothing(spark):
    """Shipping any batch again, in any order, changes no answer."""
    base = spark.range(500).select(F.concat(F.lit("r"), F.col("id") % 200).alias("record_id"), F.concat(F.lit("f"), F.col("id") % 7).alias("file"), F.col("id").alias("v"))
    once = {tuple(r) for r in one_per_record(base).collect()}
    again = base.union(base.filter("v % 3 = 0")).orderBy(F.rand(3)).repartition(9)
    assert {tuple(r) for r in one_per_record(again).collect()} == once and len(once) == 200


def test_running_total_of_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(-1).alias("g"), F.col("id").alias("o"), (F.col("id") % 5).alias("n"))
    want, run = {}, {}
    for r in df.orderBy("o").collect():
        run[r.g] = run.get(r.g, 0) + r.n
        want[r.o] = run[r.g]
    assert {r.o: r.upto for r in running_total(df, ["g"], ["o"], "n").collect()} == want
