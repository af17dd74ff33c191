"""Ranked lexical search by MaxScore with bounds of term pairs.

The index is cut into shards of documents, each with the sorted terms of its texts and a posting list of
places and frequencies for each. A block of items is answered from lists made for its terms before any item
is ranked. Lists are in stretches of ``STRETCH`` documents:

* of a term, its impacts and, for each stretch, the largest;
* of a pair of terms, the stretches where both lie in one document, with the largest joint impact there;
* of both, the value that ``top`` documents of the shard reach, a floor that every item with it starts from.

The pairs are neighbours in an item when its terms stand from the lightest to the heaviest. For a stretch,
bounds of the lightest j terms are combined when an item is ranked: an added term adds its own bound, or,
with the term before it, the bound of their pair (the largest of the joint impact and either alone) to the
bound of the terms before both, whichever is less. Terms with large lists seldom have their maxima in one
document, so these bounds are far below the sums of the terms' own.

Terms are then taken from the heaviest down. A document is passed over as soon as what it has and the
bound of the terms still to come fall under the ``top``-th value found so far, in this shard or in one the
task has ranked before; a document not met yet has nothing, so light terms add no documents, and a stretch
whose bound is low is never looked at. Ties are kept, so answers are those of ranking every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehold.llm.common import as_bytes, columns, cut, slices

TOP = 10
#: Bytes of text and documents of a shard, documents of a stretch, items that are ranked together.
SHARD_TEXT, SHARD_DOCS, STRETCH, ITEMS = 8 << 20, 1 << 14, 64, 1024
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_INDEX = "n_docs long, n_terms long, doc_id binary, size binary, terms binary, starts binary, places binary, tf binary"


def terms(text: str | None) -> list[bytes]:
    """The matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in UTF-8, only A-Z in lower case."""
    return as_bytes(text).translate(_FOLD).split()


def _ints(raw: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(raw, kind)


def _row(names: str, values: list) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    return pa.record_batch([pa.array([v], {"long": pa.int64(), "binary": pa.binary()}[t]) for v, (_, t) in zip(values, fields)], [n for n, _ in fields])


def _index(shard_text: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, sizes, found, known, held = [], [], [], {}, 0

    def shard() -> pa.RecordBatch:
        words = sorted(known)
        order = np.empty(len(words), np.int64)
        order[np.fromiter(map(known.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        size = np.array(sizes, np.int64)
        key, tf = np.unique(order[np.concatenate(found)] * len(size) + np.repeat(np.arange(len(size)), size), return_counts=True)
        starts = np.searchsorted(key, np.arange(len(words) + 1) * len(size))
        ident = np.array([[0 if i is None else i, i is None] for i in ids], "<i8")
        return _row(_INDEX, [len(size), int(size.sum()), ident.tobytes(), size.astype("<i8").tobytes(), b"\n".join(words), starts.astype("<i8").tobytes(), (key % len(size)).astype("<i4").tobytes(), tf.astype("<i4").tobytes()])

    for b in slices(batches):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            words = terms(text)
            if not words:
                continue
            ids.append(doc_id), sizes.append(len(words))
            found.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
            held += len(text)
            if held >= shard_text or len(ids) == SHARD_DOCS:
                yield shard()
                ids, sizes, found, known, held = [], [], [], {}, 0
    if ids:
        yield shard()


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_text: int = SHARD_TEXT) -> DataFrame:
    """The written index, a row for each shard. Texts without terms are in none."""
    return cut(columns(docs, doc_id=doc_id, text=text).mapInArrow(partial(_index, shard_text), _INDEX), "search-index")


def _holding(wanted: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        place = {w: i for i, w in enumerate(b.column("terms")[0].as_py().split(b"\n"))}
        starts = _ints(b.column("starts")[0].as_py())
        met = [(i, place[w]) for i, w in enumerate(wanted) if w in place]
        at = np.array([p for _, p in met], np.int64)
        yield pa.record_batch([pa.array([i for i, _ in met], pa.int64()), pa.array(starts[at + 1] - starts[at])], ["term", "df"])


class Block:
    """Some items as their terms' numbers, lightest first, with the weights of all terms."""

    def __init__(self, texts: list[str | None]):
        self.items = [sorted(set(terms(t))) for t in texts]
        self.terms = sorted({w for i in self.items for w in i})

    def weigh(self, df: dict[int, int], n: int) -> None:
        weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[i] + 1))) for i, w in enumerate(self.terms) if df.get(i)}
        self.terms = [w for w in self.terms if weight.get(w, 0) > 0]  # another term adds nothing to any score
        number = {w: i for i, w in enumerate(self.terms)}
        self.weights = np.array([weight[w] for w in self.terms], np.int64)
        self.items = [sorted((number[w] for w in i if w in number), key=lambda t: (self.weights[t], t)) for i in self.items]
        self.pairs = sorted({p for i in self.items for p in zip(i[:-1], i[1:])})


_LISTS = "n_docs long, doc_id binary, starts binary, places binary, scores binary, most binary, floor binary, pair_starts binary, pair_stretches binary, pair_most binary, pair_floor binary"


def _floor(values: np.ndarray, top: int) -> int:
    """What ``top`` of the values reach, 0 where there are fewer."""
    return int(np.partition(values, len(values) - top)[len(values) - top]) if len(values) >= top else 0


def _lists(block: Block, n: int, total: int, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        row = {c: b.column(c)[0].as_py() for c in b.schema.names}
        place = {w: i for i, w in enumerate(row["terms"].split(b"\n"))}
        starts, places, tf, size = _ints(row["starts"]), _ints(row["places"], "<i4"), _ints(row["tf"], "<i4").astype(np.int64), _ints(row["size"])
        if 90 * n * int(size.max()) < 1 << 63:
            m = 10 + 90 * n * size // total
        else:
            m = np.array([10 + 90 * n * s // total for s in size.tolist()], np.int64)
        docs, wide = len(size), -(-len(size) // STRETCH) * STRETCH
        dense, most, floors, out = {}, np.zeros((len(block.terms), wide // STRETCH), np.int64), np.zeros(len(block.terms), np.int64), []
        for t, word in enumerate(block.terms):
            at = place.get(word)
            if at is not None:
                lo, hi = starts[at], starts[at + 1]
                score = block.weights[t] * (1_000_000_000 * tf[lo:hi] // (1000 * tf[lo:hi] + 8 * m[places[lo:hi]]))
                out.append((t, places[lo:hi], score))
                line = np.zeros(wide, np.int64)
                line[places[lo:hi]] = score
                dense[t], most[t], floors[t] = line, line.reshape(-1, STRETCH).max(axis=1), _floor(score, top)
        pair_starts, stretches, joint, pair_floors = [0], [], [], np.zeros(len(block.pairs), np.int64)
        for k, (x, y) in enumerate(block.pairs):
            if x in dense and y in dense:
                both = np.where((dense[x] > 0) & (dense[y] > 0), dense[x] + dense[y], 0)
                high = both.reshape(-1, STRETCH).max(axis=1)
                some = np.flatnonzero(high)
                stretches.append(some), joint.append(high[some])
                pair_floors[k] = _floor(both[both > 0], top)
            pair_starts.append(pair_starts[-1] + (len(stretches[-1]) if x in dense and y in dense else 0))
        count = np.zeros(len(block.terms), np.int64)
        for t, p, _ in out:
            count[t] = len(p)
        flat = lambda x, kind: np.concatenate([*x, np.zeros(0, np.int64)]).astype(kind).tobytes()
        yield _row(_LISTS, [docs, row["doc_id"], flat([np.append(0, np.cumsum(count))], "<i8"), flat([p for _, p, _ in out], "<i4"), flat([s for _, _, s in out], "<i8"), most.astype("<i8").tobytes(), floors.astype("<i8").tobytes(),
                            np.array(pair_starts, "<i8").tobytes(), flat(stretches, "<i4"), flat(joint, "<i8"), pair_floors.astype("<i8").tobytes()])


class Lists:
    """The lists of one shard."""

    def __init__(self, block: Block, row: dict):
        self.starts, self.places, self.scores = _ints(row["starts"]), _ints(row["places"], "<i4"), _ints(row["scores"])
        ident = _ints(row["doc_id"]).reshape(-1, 2)
        self.n_docs, self.doc_id, self.no_id = row["n_docs"], ident[:, 0], ident[:, 1]
        self.most, self.floor, self.pair_floor = _ints(row["most"]).reshape(len(block.terms), -1), _ints(row["floor"]), _ints(row["pair_floor"])
        self.pair_starts, self.pair_stretches, self.pair_most = _ints(row["pair_starts"]), _ints(row["pair_stretches"], "<i4"), _ints(row["pair_most"])
        self.pair = {p: k for k, p in enumerate(block.pairs)}

    def bounds(self, item: list[int]) -> np.ndarray:
        """For j from 0 and each stretch, the most that a document can have of the item's first j terms."""
        out = np.zeros((len(item) + 1, self.most.shape[1]), np.int64)
        for j, t in enumerate(item, 1):
            out[j] = out[j - 1] + self.most[t]
            if j > 1:
                k = self.pair[item[j - 2], t]
                lo, hi = self.pair_starts[k], self.pair_starts[k + 1]
                two = np.maximum(self.most[item[j - 2]], self.most[t])
                two[self.pair_stretches[lo:hi]] = np.maximum(two[self.pair_stretches[lo:hi]], self.pair_most[lo:hi])
                np.minimum(out[j], out[j - 2] + two, out=out[j])
        return out

    def rank(self, item: list[int], least: int, top: int) -> tuple[np.ndarray, int]:
        """The values of all documents that may be among the ``top`` of those that reach ``least``, and how
        many entries of posting lists were added."""
        bound = self.bounds(item)
        least = max([least, 1, *[int(self.floor[t]) for t in item], *[int(self.pair_floor[self.pair[p]]) for p in zip(item[:-1], item[1:])]])
        value, added = np.zeros(self.n_docs, np.int64), 0
        for j in range(len(item), 0, -1):
            lo, hi = self.starts[item[j - 1]], self.starts[item[j - 1] + 1]
            if lo == hi or bound[j].max() + value.max() < least:
                continue
            at = self.places[lo:hi]
            own = value[at]
            may = np.flatnonzero(own + bound[j][at // STRETCH] >= least)
            value[at[may]] = own[may] + self.scores[lo:hi][may]
            added += len(may)
            if len(may) and j > 1:
                least = max(least, _floor(value, top))
        value[value < least] = 0
        return value, added


def _search(block: Block, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of the task's shards for each item; what one shard yields bounds the next."""
    best: list[tuple] = [(np.zeros(0, np.int64),) * 3 for _ in block.items]
    for b in slices(batches, 1):
        lists = Lists(block, {c: b.column(c)[0].as_py() for c in b.schema.names})
        for i, item in enumerate(block.items):
            if not item:
                continue
            held, ids, no_id = best[i]
            value, _ = lists.rank(item, int(held[-1]) if len(held) == top else 0, top)
            at = np.flatnonzero(value)
            if len(at):
                held, ids, no_id = np.append(held, value[at]), np.append(ids, lists.doc_id[at]), np.append(no_id, lists.no_id[at])
                order = np.lexsort((ids, no_id, -held))[:top]
                best[i] = held[order], ids[order], no_id[order]
    n = [len(h) for h, _, _ in best]
    yield pa.record_batch([pa.array(np.repeat(np.arange(len(best)), n), pa.int32()), pa.array(np.concatenate([x for _, x, _ in best]), mask=np.concatenate([x for _, _, x in best]).astype(bool)), pa.array(np.concatenate([x for x, _, _ in best]))], ["item", "doc_id", "score"])


def _blocks(items: DataFrame, size: int) -> Iterator[list]:
    held = []
    for r in items.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, shard_text: int = SHARD_TEXT, block: int = ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the ``top`` best documents for every item, those with a score
    above zero; equal scores by ascending doc_id, documents without an id last.

    Null and empty texts have no terms: such a document is never found and not counted, such an item finds
    nothing, like an item whose terms no document holds. Each row of either table is one of its own, so
    repeated documents follow each other and a repeated item is answered again. An empty table on either
    side gives no rows. Items go through in blocks of ``block``, the only thing the driver holds."""
    spark = docs.sparkSession
    shards = index(docs, doc_id, text, shard_text)
    n, total = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    out = None
    for rows in _blocks(columns(items, item_id=item_id, text=item_text), block):
        b = Block([r["text"] for r in rows])
        df = shards.select("terms", "starts").mapInArrow(partial(_holding, b.terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        b.weigh({r["term"]: r["df"] for r in df.collect()}, n)
        lists = cut(shards.mapInArrow(partial(_lists, b, n, total, top), _LISTS), "search-lists")
        found = lists.mapInArrow(partial(_search, b, top), "item int, doc_id long, score long")
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        named = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], "item int, item_id long")
        found = found.join(named, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
