"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Every partition sorts the fingerprints of its documents and sends each owner, who holds one range of
them, its share as a Golomb-Rice code of the differences. The owner decodes the lists of all
partitions, marks in a bitmap for each list which entries occur more than once anywhere, and sends the
bitmaps back. A partition reads its suspects off its own lists. Only the suspects' texts are shuffled
and compared byte for byte; a text whose fingerprint is alone is never moved.

An owner's range holds about ``PER_OWNER`` fingerprints whatever the corpus's size, and a list holds
``LIST_ROWS`` at most. A list names a fingerprint twice at most, which is all its owner asks, so one that
a third of all rows have adds two entries for each list of ``LIST_ROWS`` rows, not one for each copy.
Copies meet as counts that are summed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import bits_for, columns, cut

PER_OWNER, LIST_ROWS = 1 << 16, 1 << 20
_LISTS = "list string, owner int, n int, k int, first long, unary binary, low binary"
_MAX = (1 << 63) - 1


def _wide(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def normal(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Sorted unsigned 64-bit values as k, the first of them, the differences' quotients by 2^k in
    unary and their k low bits. The two streams are apart so that both decode without a loop."""
    gaps = np.diff(values)
    mean = int(values[-1] - values[0]) // max(1, len(gaps))
    k = max(0, mean.bit_length() - 1)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, ::-1]).astype(np.uint8) & 1
    return k, int(values[0]), np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def decode(n: int, k: int, first: int, unary: bytes, low: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n - 1]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    bits = np.unpackbits(np.frombuffer(low, np.uint8))[:(n - 1) * k].reshape(n - 1, k)
    for at in range(k):
        gaps += bits[:, at].astype(np.uint64) << np.uint64(k - 1 - at)
    return np.concatenate([np.array([first], np.uint64), np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)])


def _send(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held, serial = TaskContext.get().partitionId(), [], 0

    def lists() -> pa.RecordBatch:
        fps = np.sort(np.concatenate(held).view(np.uint64))
        fps = fps[np.concatenate([[True] * min(2, len(fps)), fps[2:] != fps[:-2]])]  # two of a kind say all
        owner = (fps >> np.uint64(64 - bits)).astype(np.int64)
        rows = []
        for part in np.split(fps, np.flatnonzero(np.diff(owner)) + 1):
            k, first, unary, low = encode(part)
            rows.append((f"{at}-{serial}", int(part[0]) >> 64 - bits, len(part), k, np.uint64(first).view(np.int64).item(), unary, low))
        return pa.RecordBatch.from_pydict(dict(zip([c.split()[0] for c in _LISTS.split(", ")], map(list, zip(*rows)))),
                                          pa.schema([("list", pa.string()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("first", pa.int64()), ("unary", pa.binary()), ("low", pa.binary())]))

    for b in batches:
        held.append(b.column("fp").to_numpy())
        if sum(map(len, held)) >= LIST_ROWS:
            yield lists()
            held, serial = [], serial + 1
    if sum(map(len, held)):
        yield lists()


def _decoded(row) -> np.ndarray:
    return decode(row.n, row.k, int(np.int64(row.first).view(np.uint64)), row.unary, row.low)


def _own(lists: pd.DataFrame) -> pd.DataFrame:
    """For each list of one owner, a bitmap of the entries that occur more than once among all of them."""
    own = [_decoded(r) for r in lists.itertuples()]
    values, counts = np.unique(np.concatenate(own), return_counts=True)
    twice = values[counts > 1]
    marks = [np.packbits(np.isin(v, twice, assume_unique=False, kind="sort")).tobytes() for v in own]
    return pd.DataFrame({"list": lists["list"], "owner": lists["owner"], "marks": marks})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pandas().itertuples():
            marked = np.unpackbits(np.frombuffer(row.marks, np.uint8))[:row.n].astype(bool)
            yield pa.record_batch([pa.array(np.unique(_decoded(row)[marked]).view(np.int64))], ["fp"])


def suspects(fps: DataFrame, rows: int) -> DataFrame:
    """The fingerprints (column fp of ``fps``, a signed long) that occur more than once."""
    sent = cut(fps.select("fp").mapInArrow(partial(_send, bits_for(rows, PER_OWNER, 4)), _LISTS), "golomb-lists")
    marks = sent.groupBy("owner").applyInPandas(_own, "list string, owner int, marks binary")
    return sent.join(marks, ["list", "owner"]).mapInArrow(_suspects, "fp long").distinct()


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: doc_id, keep_id, group_size, kept and text_sha256, by the text without white space.

    Of equal texts the row with the most code points in its original text stays, then the one with the
    smallest doc_id. Null and empty texts are equal to each other. A null doc_id comes after all others
    and is kept only where its group has no other at that length (keep_id is then null). Repeated rows
    count in group_size and are all kept where their id is. An empty table gives no rows."""
    base = columns(docs, doc_id=doc_id, text=text).select("doc_id", "text", normal(F.col("text")).alias("norm")).select("doc_id", "text", "norm", F.xxhash64("norm").alias("fp"))
    order = F.length(F.coalesce("text", F.lit(""))).cast("decimal(38,0)") * _wide(1 << 64) + (_wide(_MAX) - F.coalesce("doc_id", F.lit(_MAX)).cast("decimal(38,0)"))
    slim = cut(base.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")), "golomb-base")
    twice = cut(suspects(slim, docs.count()), "golomb-suspects")
    groups = (base.join(twice, "fp", "left_semi").groupBy("fp", "norm")  # equal bytes, not only equal hashes
              .agg(F.count("*").alias("group_size"), F.max(order.cast("decimal(38,0)")).alias("best"))
              .filter("group_size > 1").select("fp", F.sha2("norm", 256).alias("text_sha256"), "group_size", "best"))
    groups = groups.select("fp", "text_sha256", "group_size", (_wide(_MAX) - F.col("best") % _wide(1 << 64)).cast("long").alias("keep_id"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).when(F.col("keep_id") != _MAX, F.col("keep_id"))
    return (slim.join(groups, ["fp", "text_sha256"], "left")
            .select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"))
