"""Span trees: depth and path of every span, for one trace or all of them.

Ancestor doubling: every span starts with a pointer to its parent; a round replaces the pointer by
the pointer's pointer and prepends its path. k rounds see 2^k levels, so 64 levels take seven
self-joins on (trace, span), a key that is unique, rather than 64. Rounds stop as soon as no span
met its root: what still climbs then is in a cycle or below one. Each round is written to the shared folder, so the plan stays one join deep
and a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.session import cut


def ancestry(spans: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``trace_id, span_id, root_span_id, depth, path`` of each span under a root.

    A root has no parent or one outside its trace. Spans of a cycle, and below one, have no root and
    are left out, as are spans deeper than ``max_depth`` if one is given. ``path`` is the times from root to span.
    """
    rows = spans.select("trace_id", "span_id", "parent_span_id", "time")
    ids = rows.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_inside"))
    # The probe side keeps every span; a parent with many children is a hot key only on this side,
    # which the adaptive skew join splits.
    state = cut(rows.join(ids, ["trace_id", "parent_span_id"], "left").select(
        "trace_id", "span_id", F.when(F.col("_inside"), F.col("parent_span_id")).alias("up"),
        F.when(F.col("_inside"), 1).otherwise(0).alias("depth"), F.array("time").alias("path"),
        F.col("span_id").alias("root_span_id")), "tree")
    done, climbing, seen, met = state.filter("up IS NULL"), state.filter("up IS NOT NULL"), 1, True
    while met and (max_depth is None or seen <= 2 * max_depth) and not climbing.isEmpty():
        # Only spans still below their root move; what they climb to may be finished or not.
        above = done.unionByName(climbing).select(
            "trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"),
            F.col("path").alias("_path"), F.col("root_span_id").alias("_root"))
        state = cut(climbing.join(above, ["trace_id", "up"]).select(
            "trace_id", "span_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
            F.concat("_path", "path").alias("path"), F.col("_root").alias("root_span_id")), "tree")
        found = state.filter("up IS NULL")
        met, done, climbing = not found.isEmpty(), done.unionByName(found), state.filter("up IS NOT NULL")
        seen *= 2
    return (done if max_depth is None else done.filter(F.col("depth") <= max_depth)).drop("up")


def trace_tree(spans: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The spans with their ``depth``, ``path`` and ``root_span_id``. The spans are written once, and both
    the climb and the join that ends it read them there."""
    spans = cut(spans, "spans")
    return spans.join(ancestry(spans, max_depth), ["trace_id", "span_id"])
