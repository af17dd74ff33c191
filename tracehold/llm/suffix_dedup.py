"""Removal of byte strings that repeat: column-wise construction over a collection of pieces.

A 200-byte string that occurs twice has the same 32-byte grams, so its least gram (by hash, leftmost) is
an *anchor* at the same place in both. Texts are cut into the pieces around their anchors: every string
that repeats lies whole in pieces of one anchor gram, and starts in the same column of them. Pieces of a
gram that occurs once are never moved. Pieces that are equal are settled by their 128 bits of hash and
their count; the others, mostly the edges of copied passages, go to tasks by their gram.

A task builds the Burrows-Wheeler transform and the common prefixes of its pieces column by column: each
round puts one symbol of every piece before its suffix, orders the suffixes that start in that column by
that symbol and their order in the last round, and gets the common prefix of neighbours as one more than
the least between them in the last round. Symbols lie in a file by column and are read once, in order;
only the order and the common prefixes of one column are held. Neighbours with a common prefix of 200
bytes are a repeat. As equal strings share a column, columns need not be merged into one transform.

A gram with more than ``GROUP`` different pieces is dealt out to several tasks; windows that are alone
in theirs are then compared by hash across them, so no group must fit one task.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import as_bytes, columns, cut, slices

LENGTH, GRAM = 200, 32
BLOCK, GROUP, TASK = 1 << 20, 1 << 16, 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64((1 << 21) - 1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Anchors:
    """Anchors of byte strings for matches of ``length``; a piece reaches ``back`` before and ``length``
    after its anchor."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.window = length, gram, length - gram + 1
        self.back = length - gram

    def _of(self, data: np.ndarray, base: int, total: int, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a block that lies at ``base`` of a text of ``total`` bytes: anchors of the strings that
        start in the first ``fresh`` places from ``skip`` on, hashes of gram and piece."""
        power, inverse = _powers(BLOCK + 4 * self.length)
        n = len(data)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])])
            grams = _mixed((sums[self.gram:] - sums[:-self.gram]) * inverse[:n - self.gram + 1])
        skip = min(base, self.back)
        key = ((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64))[skip:skip + fresh + self.window - 1]
        step = 1
        while 2 * step <= self.window:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if self.window > step:
            key = np.minimum(key[:len(key) - (self.window - step)], key[self.window - step:])
        here = np.zeros(len(grams), bool)
        here[(key & _PLACE).astype(np.int64)] = True
        at = np.flatnonzero(here)
        low, high = np.maximum(at - self.back, 0), np.minimum(at + self.length, n)
        with np.errstate(over="ignore"):
            piece = _mixed((sums[high] - sums[low]) * inverse[low] + ((at - low) * 1024 + (high - at)).astype(np.uint64) * np.uint64(_BASE))
        return at + base, grams[at], piece

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, total = np.frombuffer(raw, np.uint8), len(raw)
        starts = total - self.length + 1
        parts = []
        for a in range(0, max(0, starts), BLOCK):
            fresh = min(BLOCK, starts - a)
            low, high = max(0, a - self.back), min(total, a + fresh + 2 * self.length)
            parts.append(self._of(data[low:high], low, total, fresh))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at, h, g = map(np.concatenate, zip(*parts))
        if len(parts) > 1:  # neighbouring blocks may find one anchor
            at, first = np.unique(at, return_index=True)
            h, g = h[first], g[first]
        return at, h, g


def _prepare(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, pack = Anchors(length, gram), zstandard.ZstdCompressor(level=3)
    for b in slices(batches):
        raws = [as_bytes(t) for t in b.column("text").to_pylist()]
        found = [find(r) for r in raws]
        yield pa.record_batch([b.column("key"), b.column("doc_id"), pa.array([pack.compress(r) for r in raws], pa.binary()), pa.array(list(map(len, raws))),
                               *[pa.array([f[i].view(np.int64) for f in found], pa.list_(pa.int64())) for i in range(3)]], ["key", "doc_id", "packed", "n_bytes", "at", "h", "g"])


def _cut_pieces(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces that are asked for, padded to full width."""
    back, unpack = length - gram, zstandard.ZstdDecompressor()
    for b in slices(batches, 32):
        rows = []
        for r in b.to_pylist():
            raw = unpack.decompress(r["packed"], max_output_size=max(1, r["n_bytes"]))
            for w in r["wanted"]:
                low, high = max(0, w["at"] - back), min(len(raw), w["at"] + length)
                rows.append((r["key"], w["at"], w["h"], w["n"], w["parts"], w["part"], low - (w["at"] - back), high - (w["at"] - back), raw[low:high]))
        yield pa.RecordBatch.from_pydict(dict(zip([n for n, _ in _PIECE], map(list, zip(*rows)))) if rows else {n: [] for n, _ in _PIECE}, pa.schema(_PIECE))


_PIECE = [("key", pa.int64()), ("at", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("parts", pa.int32()), ("part", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("piece", pa.binary())]
_FOUND = [("kind", pa.string()), ("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("h", pa.int64()), ("col", pa.int32()), ("window", pa.int64())]
_FOUND_SQL = "kind string, key long, start long, stop long, h long, col int, window long"


def _least_between(prefix: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of prefix[left + 1..right] for each pair, from tables of the least over powers of two."""
    out, size = np.zeros(len(left), prefix.dtype), right - left
    order = np.argsort(size, kind="stable")
    table, step, at = prefix, 1, 0
    bounds = np.searchsorted(size[order], 2 ** np.arange(1, int(size.max(initial=1)).bit_length() + 1))
    for bound in bounds.tolist():
        some = order[at:bound]
        out[some] = np.minimum(table[left[some] + 1], table[right[some] + 1 - step])
        at = bound
        if at < len(order):
            table, step = np.minimum(table[:-step], table[step:]), 2 * step
    return out


def columns_of(symbols: np.memmap, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column from the last to the first of ``symbols`` (columns, pieces): the pieces in the
    order of their suffixes from that column, and each one's common prefix with the one before, at most
    ``length``. The symbols in the order of the column after are the transform's next part."""
    width, m = symbols.shape
    order, prefix = np.arange(m), np.full(m, 0, np.int16)
    for col in range(width - 1, -1, -1):
        bwt = np.asarray(symbols[col])[order]
        by = np.argsort(bwt, kind="stable")
        inserted = bwt[by]
        same = np.flatnonzero(inserted[1:] == inserted[:-1]) + 1
        fresh = np.zeros(m, np.int16)
        fresh[same] = np.minimum(_least_between(prefix, by[same - 1], by[same]) + 1, length)
        order, prefix = order[by], fresh
        yield col, order, prefix


def _compare(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pieces: intervals of texts that repeat, and where a gram has several tasks, its windows."""
    back, width = length - gram, 2 * length - gram
    with tempfile.TemporaryFile() as file:
        meta, m = [], 0
        for b in slices(batches, 4096):  # the pieces go to the file as rows, and from there by column
            block = np.full((b.num_rows, width), 256, np.uint16)
            for i, (low, high, piece) in enumerate(zip(b.column("low").to_pylist(), b.column("high").to_pylist(), b.column("piece").to_pylist())):
                block[i, low:high] = np.frombuffer(piece, np.uint8)
            block.tofile(file)
            meta.append([b.column(n).to_numpy() for n in ("key", "at", "h", "n", "parts", "low", "high")])
            m += b.num_rows
        if not m:
            return
        key, at, h, n, parts, low, high = map(np.concatenate, zip(*meta))
        file.flush()
        with tempfile.TemporaryFile() as by_column:
            rows = np.memmap(file, np.uint16, "r", 0, (m, width))
            for c in range(0, width, 16):
                np.ascontiguousarray(rows[:, c:c + 16].T).tofile(by_column)
            by_column.flush()
            symbols = np.memmap(by_column, np.uint16, "r", 0, (width, m))
            repeated = np.zeros((m, back + 1), bool)
            spread = parts > 1
            for col, order, prefix in columns_of(symbols, length):
                if col > back:
                    continue
                begins = prefix < length
                kind = np.cumsum(begins) - 1
                size = np.bincount(kind)
                valid = (low[order] <= col) & (col + length <= high[order])
                repeated[order, col] = (size[kind] > 1) & valid
                if spread.any():  # each different window once, and the single ones with their place
                    some = order[begins & valid & spread[order]]
                    if len(some):
                        window = np.array([int.from_bytes(hashlib.blake2b(np.ascontiguousarray(rows[i, col:col + length]).tobytes(), digest_size=8).digest(), "little", signed=True) for i in some.tolist()], np.int64)
                        alone = ~repeated[some, col] & (n[some] == 1)
                        yield pa.record_batch([pa.array(np.where(alone, "alone", "seen")), pa.array(key[some]), pa.array(at[some] - back + col), pa.array(at[some] - back + col + length), pa.array(h[some]),
                                               pa.array(np.full(len(some), col, np.int32)), pa.array(window)], schema=pa.schema(_FOUND))
            edges = np.diff(np.pad(repeated[n == 1], ((0, 0), (1, 1))).astype(np.int8), axis=1)
            who, first = np.nonzero(edges == 1)
            last = np.nonzero(edges == -1)[1]
            key, at = key[n == 1][who], at[n == 1][who]
            none = pa.nulls(len(who), pa.int64())
            yield pa.record_batch([pa.array(["repeat"] * len(who), pa.string()), pa.array(key), pa.array(at - back + first), pa.array(at - back + last - 1 + length), none, none.cast(pa.int32()), none], schema=pa.schema(_FOUND))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in slices(batches, 32):
        rows = []
        for r in b.to_pylist():
            raw = unpack.decompress(r["packed"], max_output_size=max(1, r["n_bytes"]))
            runs: list[list[int]] = []
            for x in sorted((max(0, s["start"]), min(len(raw), s["stop"])) for s in r["spans"] or ()):
                if runs and x[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], x[1])
                else:
                    runs.append(list(x))
            edges = [0, *[e for run in runs for e in run], len(raw)]
            kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
            rows.append((r["doc_id"], len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, task: int = TASK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) for every row:
    each byte goes that a string of ``length`` bytes covers which starts anywhere else too, in the same
    text included, judged on the texts as they are.

    Null and empty texts have nothing to remove; texts shorter than ``length`` stay whole. Repeated rows
    are copies of each other, so both lose every byte that a string covers. Each row has a key of its own, fixed
    when the texts are written, so ids may be null or repeat. An empty table gives no rows."""
    spark = docs.sparkSession
    base = columns(docs, doc_id=doc_id, text=text).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    packed = cut(base.mapInArrow(partial(_prepare, length, gram), "key long, doc_id long, packed binary, n_bytes long, at array<long>, h array<long>, g array<long>"), "repeats-texts")
    anchors = packed.select("key", F.explode(F.arrays_zip("at", "h", "g")).alias("a")).select("key", F.col("a.at").cast("int").alias("at"), "a.h", "a.g")
    # grams that occur once hold no repeat; counts are combined before the shuffle
    # (written, so that the join below deals out both sides itself and can split a frequent gram)
    often = cut(packed.select(F.explode("h").alias("h")).groupBy("h").count().filter("count > 1").select("h"), "repeats-grams")
    some = cut(anchors.join(often, "h", "left_semi"), "repeats-anchors")
    pieces = cut(some.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("key").alias("key")), "repeats-pieces")
    many = cut(pieces.groupBy("h").agg(F.count("*").alias("different")).filter("different > 1"), "repeats-many")
    parts = F.ceil(F.col("different") / group).cast("int")
    # one place of each different piece is enough: any of the least text that has it
    wanted = cut(pieces.join(many, "h").select("h", "g", "n", "key", parts.alias("parts"), F.pmod(F.xxhash64("g"), parts).cast("int").alias("part")), "repeats-wanted")
    places = some.join(wanted, ["h", "g", "key"]).groupBy("h", "g", "key", "n", "parts", "part").agg(F.min("at").alias("at"))
    by_text = places.groupBy("key").agg(F.collect_list(F.struct("at", "h", "n", "parts", "part")).alias("wanted"))
    shown = packed.select("key", "packed", "n_bytes").join(by_text, "key").mapInArrow(partial(_cut_pieces, length, gram), "key long, at long, h long, n long, parts int, part int, low int, high int, piece binary")
    tasks = max(1, -(-wanted.count() // task))
    found = cut(shown.repartition(tasks, "h", "part").mapInArrow(partial(_compare, length, gram), _FOUND_SQL), "repeats-found")
    windows = found.filter("kind <> 'repeat'")
    across = windows.groupBy("h", "col", "window").count().filter("count > 1")
    spans = found.filter("kind = 'repeat'").select("key", "start", "stop").unionByName(windows.filter("kind = 'alone'").join(across, ["h", "col", "window"], "left_semi").select("key", "start", "stop"))
    back = length - gram
    whole = some.join(pieces.filter("n > 1").select("h", "g"), ["h", "g"], "left_semi").select("key", (F.col("at").cast("long") - back).alias("start"), (F.col("at").cast("long") + length).alias("stop"))
    of = whole.unionByName(spans).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return (packed.select("key", "doc_id", "packed", "n_bytes").join(of, "key", "left")
            .mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
